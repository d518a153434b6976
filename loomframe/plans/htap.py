"""Transactions over versioned tables.

A version is a manifest: the data files of each table. A batch of transactions
reads the latest version and writes only what it changes, under a folder of its
own: appended rows are further files of their table, an updated table is
replaced, all others are carried over by name. Readers keep the version they
opened, so queries run beside updates. A redo log has a record for every
transaction. Files that no kept version names are removed.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hashed, hashed_sql
from ..registry import register
from ..tables import _delete, plain, run_sql, scratch, table
from .tpch import PARTSUPP, VARIANTS

TABLES = ("customer", "orders", "lineitem", "partsupp", "queue")
_QUEUE = "seq long, o_orderkey long"


class Store:
    """Tables customer, orders, lineitem and partsupp, and the queue of orders to be shipped, in versions under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 1_000_000):
        self.spark, self.path, self.keep = spark, path, keep
        self.history: list[dict | None] = []  # of each version: files by table, orders queued and shipped so far; None when dropped

    @property
    def version(self) -> int:
        return len(self.history) - 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.history[self.version if version is None else version]
        if held is None:
            raise ValueError(f"version {version} is no longer kept")
        return self.spark.read.parquet(*held["files"][name])

    def versions(self) -> list[int]:
        return [v for v, held in enumerate(self.history) if held is not None]

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, queued: int = 0, shipped: int = 0) -> int:
        """The next version: with tables replaced, rows appended, and all else as it was."""
        new = len(self.history)
        last = self.history[-1] if self.history else {"files": {}, "queued": 0, "shipped": 0}
        files = {t: list(f) for t, f in last["files"].items()}
        for name, df in (replaced or {}).items():
            files[name] = [f"{self.path}/v{new}/{name}"]
            df.write.parquet(files[name][0])
        for name, df in (appended or {}).items():
            at = f"{self.path}/v{new}/{name}-more"
            df.write.parquet(at)
            files[name] = [*files.get(name, []), at]
        held = {"files": files, "queued": last["queued"] + queued, "shipped": last["shipped"] + shipped}
        # the manifest comes last: a version is there once all of its files are
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/v{new}")
        self.history.append(held)
        self._drop(new - self.keep)
        return new

    def _drop(self, version: int) -> None:
        if version < 0 or self.history[version] is None:
            return
        gone = {f for files in self.history[version]["files"].values() for f in files}
        self.history[version] = None
        used = {f for held in self.history if held for files in held["files"].values() for f in files}
        for f in gone - used:
            _delete(self.spark, f)
        _delete(self.spark, f"{self.path}/manifest/v{version}")

    def log(self, records: DataFrame) -> None:
        """Appends (value) records to the redo log."""
        records.write.mode("append").text(f"{self.path}/log")

    def logged(self) -> DataFrame:
        return self.spark.read.text(f"{self.path}/log")

    def new_orders(self, orders: DataFrame, lines: DataFrame) -> int:
        """Appends orders with their lines, takes the lines' quantities off what is available, queues the orders by key, and records N|order|customer."""
        from ..operators.sequence import dense

        self.log(orders.select(F.concat_ws("|", F.lit("N"), "o_orderkey", "o_custkey").alias("value")))
        taken = lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.sum("l_quantity").alias("taken"))
        ps = self.read("partsupp")
        left = ps.join(taken, ["ps_partkey", "ps_suppkey"], "left").withColumn("ps_availqty", F.col("ps_availqty") - F.coalesce("taken", F.lit(0.0))).select(*ps.columns)
        before = self.history[-1]["queued"]
        queue = dense(orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey")), ["o_orderkey"]).select((F.col("idx") + before).alias("seq"), "o_orderkey")
        return self.commit({"partsupp": left}, {"orders": orders, "lineitem": lines, "queue": queue}, queued=orders.count())

    def payments(self, paid: DataFrame) -> int:
        """Takes amounts (custkey, amount) off the customers' balances: one upsert for the whole batch."""
        self.log(paid.select(F.concat_ws("|", F.lit("P"), "custkey", "amount").alias("value")))
        sums = paid.groupBy(F.col("custkey").alias("c_custkey")).agg(F.sum("amount").alias("a"))
        c = self.read("customer")
        return self.commit({"customer": c.join(sums, "c_custkey", "left").withColumn("c_acctbal", F.col("c_acctbal") - F.coalesce("a", F.lit(0.0))).select(*c.columns)})

    def open_orders(self, n: int | None = None) -> DataFrame:
        """(o_orderkey) of the oldest ``n`` queued orders that are not shipped yet."""
        shipped, queued = self.history[-1]["shipped"], self.history[-1]["queued"]
        to = queued if n is None else min(queued, shipped + n)
        return self.read("queue").where((F.col("seq") >= shipped) & (F.col("seq") < to)).select("o_orderkey")

    def shipments(self, orders: DataFrame, date: Column, dequeued: int = 0) -> int:
        """Ships all lines of the orders (o_orderkey): date and status O; their customers' balances rise by the total price."""
        self.log(orders.select(F.concat_ws("|", F.lit("S"), "o_orderkey").alias("value")))
        due = self.read("orders").join(orders, "o_orderkey", "left_semi")
        mark = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("__s"))
        li, c = self.read("lineitem"), self.read("customer")
        shipped = li.join(mark, "l_orderkey", "left").withColumn("l_shipdate", F.when(F.col("__s"), date).otherwise(F.col("l_shipdate"))).withColumn("l_linestatus", F.when(F.col("__s"), "O").otherwise(F.col("l_linestatus")))
        add = due.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("a"))
        customers = c.join(add, "c_custkey", "left").withColumn("c_acctbal", F.col("c_acctbal") + F.coalesce("a", F.lit(0.0)))
        return self.commit({"lineitem": shipped.select(*li.columns), "customer": customers.select(*c.columns)}, shipped=dequeued)

    def ship_next(self, n: int, date: Column) -> int:
        """Ships the oldest ``n`` open orders, or as many as there are."""
        own = self.open_orders(n)
        return self.shipments(own, date, own.count())


def open_store(spark: SparkSession, sf_dir: str, keep: int = 1_000_000) -> Store:
    store = Store(spark, scratch(spark), keep)
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    store.commit({**tables, "partsupp": run_sql(spark, sf_dir, f"select * from {PARTSUPP}"), "queue": spark.createDataFrame([], _QUEUE)})
    return store


def transaction_kind(seq: Column) -> Column:
    """N, P or S in the proportion 45 : 43 : 4, by a hash of the sequence number."""
    h = hashed(seq) % 92
    return F.when(h < 45, "N").when(h < 88, "P").otherwise("S")


def generated_orders(ids: DataFrame, customers: int, parts: int, suppliers: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(orders, lines) of new orders (id): 1 to 7 lines each, all drawn by hash; a line costs its quantity times 900 plus the part's number."""
    o = ids.select(F.col("id").alias("o_orderkey"), (hashed(F.col("id"), seed=seed) % customers).alias("o_custkey"), (1 + hashed(F.col("id"), seed=seed + 1) % 7).alias("k"))
    lines = o.select("o_orderkey", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("l_linenumber"))
    of = lambda n: hashed(F.col("o_orderkey"), F.col("l_linenumber"), seed=seed + n)
    lines = lines.withColumn("l_partkey", of(2) % parts).withColumn("l_suppkey", of(3) % suppliers).withColumn("l_quantity", (1 + of(4) % 10).cast("double"))
    lines = lines.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_quantity") * (900 + F.col("l_partkey"))).alias("l_extendedprice"))
    total = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("o_totalprice"))
    return o.join(total, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice"), lines


def as_of(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns and types of ``like``; those they lack are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def replay(store: Store, first: int, n: int, batch: int, customers: int, parts: int, suppliers: int) -> None:
    """Draws ``n`` transactions and runs them in batches: a batch's new orders, then its payments, then ten shipments for each S.

    The k-th transaction pays 1 to 5000 or places order ``first`` + k.
    """
    spark = store.spark
    for at in range(0, n, batch):
        drawn = spark.range(at, min(n, at + batch)).withColumn("kind", transaction_kind(F.col("id")))
        counts = {r.kind: r["count"] for r in drawn.groupBy("kind").count().collect()}  # three rows
        if counts.get("N"):
            orders, lines = generated_orders(drawn.where("kind = 'N'").select((F.col("id") + first).alias("id")), customers, parts, suppliers)
            store.new_orders(as_of(orders, store.read("orders")), as_of(lines, store.read("lineitem")))
        if counts.get("P"):
            store.payments(drawn.where("kind = 'P'").select((hashed(F.col("id"), seed=11) % customers).alias("custkey"), (1 + hashed(F.col("id"), seed=12) % 5000).cast("double").alias("amount")))
        if counts.get("S"):
            store.ship_next(10 * counts["S"], F.lit("2002-01-01").cast("timestamp_ntz"))


def run_beside(store: Store, updates: list, query) -> list[tuple[int, object]]:
    """(version, result) of ``query`` (a function of a version), run on each version while the next update is under way."""
    out = []
    with ThreadPoolExecutor(1) as writer:
        for update in [*updates, None]:
            version = store.version
            under_way = writer.submit(update) if update else None
            out.append((version, query(version)))
            if under_way:
                under_way.result()
    return out


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    """Rows of delimited text, each line closed by a separator or not; an empty number is null; a line with another number of fields is an error."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    parts = spark.read.text(path).where("value <> ''").select("value", F.split(F.regexp_replace("value", f"[{sep}]$", ""), f"[{sep}]", -1).alias("f"))
    checked = F.when(F.size("f") == len(fields), F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"not {len(fields)} fields: "), F.col("value"))))
    value = lambda i, x: F.get("f", F.lit(i)) if x.dataType.simpleString() == "string" else F.nullif(F.get("f", F.lit(i)), F.lit(""))
    return parts.select(checked.alias("f")).select(*[value(i, x).cast(x.dataType).alias(x.name) for i, x in enumerate(fields)])


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.select(F.concat(*[x for c in df.columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(sep))]).alias("value")).write.text(path)


#: The indexes of the order tables: the columns of their outer keys.
INDEXES = {"om": ("orders", "o_orderkey"), "oom": ("orders", "cast(o_orderdate as date)"), "cm": ("orders", "o_custkey"), "sm": ("lineitem", "cast(l_shipdate as date)"), "rm": ("lineitem", "cast(l_shipdate + interval '10' day as date)"), "psm2": ("partsupp", "ps_partkey"), "spm2": ("partsupp", "ps_suppkey")}


def build_indexes(spark: SparkSession, sf_dir: str, path: str, buckets: int = 16) -> dict[str, str]:
    """Folder of each index: its table in ``buckets`` sorted partitions by outer key, so that a look-up reads one and skips row groups."""
    out = {}
    for name, (t, key) in INDEXES.items():
        rows = run_sql(spark, sf_dir, f"select {key} as k, t.* from {PARTSUPP if t == 'partsupp' else '{' + t + '}'} t")
        at = f"{path}/{name}"
        rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets))).repartition(buckets, "bucket").sortWithinPartitions("bucket", "k").write.partitionBy("bucket").parquet(at)
        out[name] = at
    return out


def look_up(spark: SparkSession, path: str, key: Column, buckets: int = 16) -> DataFrame:
    """The rows of one outer key."""
    return spark.read.parquet(path).where((F.col("bucket") == F.pmod(F.xxhash64(key), F.lit(buckets))) & (F.col("k") == key))


def _payment(s, d):
    store = open_store(s, d)
    store.payments(table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("amount")))
    return store.read("customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


_SHIFT = 1 << 34


def _order_all_again(s, d):
    store = open_store(s, d)
    store.new_orders(table(s, d, "orders").withColumn("o_orderkey", F.col("o_orderkey") + _SHIFT), table(s, d, "lineitem").withColumn("l_orderkey", F.col("l_orderkey") + _SHIFT))
    return store


def _new_order(s, d):
    store = _order_all_again(s, d)
    counts = [store.read(t, v).agg(F.lit(t).alias("name"), F.lit(v).alias("version"), F.count("*").alias("n")) for t in ("orders", "lineitem") for v in (0, 1)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def _shipment(s, d):
    store = open_store(s, d, keep=2)
    store.shipments(table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), F.lit("2002-01-01").cast("timestamp_ntz"))
    return store.read("customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def _queue(s, d):
    """All orders again, then the oldest 100 and the next 50 shipped: what is left in the queue."""
    store = _order_all_again(s, d)
    for n in (100, 50):
        store.ship_next(n, F.lit("2002-01-01").cast("timestamp_ntz"))
    shipped = store.read("lineitem").where((F.col("l_orderkey") >= _SHIFT) & (F.col("l_shipdate") == F.lit("2002-01-01").cast("timestamp_ntz"))).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return store.open_orders().select((F.col("o_orderkey") - _SHIFT).alias("o_orderkey"), F.lit("open").alias("state")).unionByName(shipped.select((F.col("o_orderkey") - _SHIFT).alias("o_orderkey"), F.lit("shipped").alias("state")))


def _sizes(s, d):
    return table(s, d, "customer").count(), table(s, d, "part").count(), table(s, d, "supplier").count()


_MIX, _BATCH = 400, 100


def _mixed(s, d):
    store = open_store(s, d, keep=2)
    replay(store, _SHIFT, _MIX, _BATCH, *_sizes(s, d))
    return store.read("customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def _generated_sql(ids: str, seed: int = 1) -> str:
    """Lines of the new orders (id)."""
    of = lambda n: hashed_sql("id", "j", seed=seed + n)
    return f"""(select id as l_orderkey, cast(j as int) as l_linenumber, {of(2)} % (select count(*) from part) as l_partkey, {of(3)} % (select count(*) from supplier) as l_suppkey, cast(1 + {of(4)} % 10 as double) as l_quantity,
  (1 + {of(4)} % 10) * (900 + {of(2)} % (select count(*) from part)) * 1e0 as l_extendedprice from (select id, unnest(range(1, 2 + {hashed_sql("id", seed=seed + 1)} % 7)) as j from {ids}))"""


_MIX_SQL = f"""with recursive t as (select id, id // {_BATCH} as b, {hashed_sql("id")} % 92 as h from range({_MIX}) r(id)),
  n as (select id + {_SHIFT} as id, b, row_number() over (order by id) - 1 as seq, {hashed_sql(f"id + {_SHIFT}", seed=1)} % (select count(*) from customer) as cust from t where h < 45),
  price as (select l_orderkey as id, sum(l_extendedprice) as total from {_generated_sql("n")} group by 1),
  want as (select b, 10 * count(*) filter (h >= 88) as k, (select count(*) from n where n.b <= t.b) as queued from t group by b),
  done(b, upto) as (select cast(-1 as bigint), cast(0 as bigint) union all select w.b, least(w.queued, d.upto + w.k) from done d join want w on w.b = d.b + 1),
  pay as (select {hashed_sql("id", seed=11)} % (select count(*) from customer) as cust, -(1 + {hashed_sql("id", seed=12)} % 5000) as a from t where h >= 45 and h < 88),
  moves as (select cust, a * 1e0 as a from pay union all select cust, total from n join price using (id) where seq < (select max(upto) from done))
select c_custkey, round(c_acctbal + coalesce((select sum(a) from moves where cust = c_custkey), 0), 2) as c_acctbal from customer"""


def _beside(s, d):
    store = open_store(s, d)
    n = table(s, d, "orders")
    updates = [lambda i=i: store.commit(appended={"orders": n.where("o_orderkey % 10 = 0").withColumn("o_orderkey", F.col("o_orderkey") + (i + 1) * _SHIFT)}) for i in range(3)]
    return s.createDataFrame(run_beside(store, updates, lambda v: store.read("orders", v).count()), "version long, orders long")


def _log(s, d):
    store = open_store(s, d)
    store.payments(table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("amount")))
    store.shipments(table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), F.lit("2002-01-01").cast("timestamp_ntz"))
    return store.logged()


def _history(s, d):
    store = open_store(s, d, keep=2)
    for i in range(4):
        store.payments(table(s, d, "customer").select(F.col("c_custkey").alias("custkey"), F.lit(float(i + 1)).alias("amount")))
    kept = [store.read("customer", v).agg(F.lit(v).alias("version"), F.round(F.sum("c_acctbal"), 2).alias("balance")) for v in store.versions()]
    return kept[0].unionByName(kept[1])


def _loaded(s, d):
    path = scratch(s)
    write_delimited(table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return read_delimited(s, path, "s_suppkey long, s_name string, s_nationkey int")


def _indexes(s, d):
    built = build_indexes(s, d, scratch(s))
    out = None
    for name, path in built.items():
        one = s.read.parquet(path).agg(F.lit(name).alias("name"), F.count_distinct("k").alias("keys"), F.count("*").alias("entries"))
        out = one if out is None else out.unionByName(one)
    return out


def _query_loop(s, d):
    out = None
    for name, template in VARIANTS.items():
        one = run_sql(s, d, template).agg(F.lit(name).alias("query"), F.count("*").alias("answers"))
        out = one if out is None else out.unionByName(one)
    return out


register("txn_payment", "select c_custkey, round(c_acctbal - coalesce((select sum(floor(o_totalprice / 100)) from orders where o_custkey = c_custkey), 0), 2) as c_acctbal from customer")(_payment)
register("txn_new_order", "select 'orders' as name, 0 as version, count(*) as n from orders union all select 'orders', 1, 2 * count(*) from orders union all select 'lineitem', 0, count(*) from lineitem union all select 'lineitem', 1, 2 * count(*) from lineitem")(_new_order)
register("txn_availability", "select l_partkey as ps_partkey, l_suppkey as ps_suppkey, 10 * count(*) - sum(l_quantity) as ps_availqty from lineitem group by 1, 2")(lambda s, d: _order_all_again(s, d).read("partsupp").select("ps_partkey", "ps_suppkey", "ps_availqty"))
register("txn_shipment", "select c_custkey, round(c_acctbal + coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey and o_orderstatus = 'P'), 0), 2) as c_acctbal from customer")(_shipment)
_Q = "(select o_orderkey, row_number() over (order by o_orderkey) as p from orders)"
register("txn_open_orders", f"select o_orderkey, 'open' as state from {_Q} where p > 150 union all select distinct o_orderkey, 'shipped' from {_Q} join lineitem on l_orderkey = o_orderkey where p <= 150")(_queue)
register("txn_kinds", f"select id, case when {hashed_sql('id')} % 92 < 45 then 'N' when {hashed_sql('id')} % 92 < 88 then 'P' else 'S' end as kind from range(1000) t(id)")(lambda s, d: s.range(1000).select("id", transaction_kind(F.col("id")).alias("kind")))
register("txn_mix", _MIX_SQL)(_mixed)
register("txn_generated", f"select * from {_generated_sql('(select c_custkey as id from customer)')}")(lambda s, d: generated_orders(table(s, d, "customer").select(F.col("c_custkey").alias("id")), *_sizes(s, d))[1])
register("htap_concurrent", "select v as version, (select count(*) from orders) + v * (select count(*) from orders where o_orderkey % 10 = 0) as orders from range(4) t(v)")(_beside)
register("redo_log", "select 'P|' || o_custkey || '|' || o_orderkey as value from orders union all select 'S|' || o_orderkey from orders where o_orderstatus = 'P'")(_log)
register("version_history", "select v as version, round(sum(c_acctbal) - count(*) * (v * (v + 1) // 2), 2) as balance from customer, range(3, 5) t(v) group by v")(_history)
register("table_loader", "select s_suppkey, s_name, s_nationkey from supplier")(_loaded)
register("index_build", " union all ".join(f"select '{n}' as name, count(distinct {k}) as keys, count(*) as entries from {plain(PARTSUPP) if t == 'partsupp' else t} t" for n, (t, k) in INDEXES.items()))(_indexes)
register("index_look_up", "select o_orderkey, o_custkey from orders where o_custkey = 7")(lambda s, d: look_up(s, build_indexes(s, d, scratch(s))["cm"], F.lit(7).cast("long")).select("o_orderkey", "o_custkey"))
register("query_loop", " union all ".join(f"select '{n}' as query, count(*) as answers from ({plain(t)})" for n, t in VARIANTS.items()))(_query_loop)
register("primary_index", "select o_orderkey, any_value(o_custkey) as o_custkey from orders group by 1")(lambda s, d: table(s, d, "orders").dropDuplicates(["o_orderkey"]).select("o_orderkey", "o_custkey"))
register("secondary_index", "select o_custkey, list(o_orderkey order by o_orderkey) as orders from orders group by 1")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders")))
register("paired_index", "select o_orderkey, o_custkey, l_partkey from orders left join lineitem on l_orderkey = o_orderkey")(lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_custkey", "l_partkey"))
register("geo_mean", "select round(exp(avg(ln(o_totalprice))), 4) as g, round(exp(stddev_pop(ln(o_totalprice))), 6) as sd from orders")(lambda s, d: table(s, d, "orders").agg(F.round(F.exp(F.avg(F.log("o_totalprice"))), 4).alias("g"), F.round(F.exp(F.stddev_pop(F.log("o_totalprice"))), 6).alias("sd")))
