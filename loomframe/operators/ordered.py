"""Ordered maps: a map is a DataFrame (k, v) with unique k; every operator returns a new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from ..tables import table
from .sequence import dense, kth_smallest, ranged, scan

Combine = Callable[[Column, Column], Column]


def build(rows: DataFrame, wins: str = "max") -> DataFrame:
    """A map of rows (k, v); of equal keys the greatest (or least) value wins."""
    return rows.groupBy("k").agg((F.max if wins == "max" else F.min)("v").alias("v"))


def build_combine(rows: DataFrame, agg: Callable[[str], Column]) -> DataFrame:
    return rows.groupBy("k").agg(agg("v").alias("v"))


def multi_insert(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert: a key of ``rows`` (unique keys) replaces the map's."""
    return union(m, rows, lambda old, new: new)


def union(a: DataFrame, b: DataFrame, op: Combine) -> DataFrame:
    both = a.toDF("k", "va").join(b.toDF("k", "vb"), "k", "full")
    return both.select("k", F.when(F.col("va").isNull(), F.col("vb")).when(F.col("vb").isNull(), F.col("va")).otherwise(op(F.col("va"), F.col("vb"))).alias("v"))


def intersect(a: DataFrame, b: DataFrame, op: Combine) -> DataFrame:
    return a.toDF("k", "va").join(b.toDF("k", "vb"), "k").select("k", op(F.col("va"), F.col("vb")).alias("v"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("k"), "k", "left_anti")


def multi_update(m: DataFrame, rows: DataFrame, op: Combine) -> DataFrame:
    """Existing keys only: op(old, new)."""
    both = m.toDF("k", "va").join(rows.toDF("k", "vb"), "k", "left")
    return both.select("k", F.when(F.col("vb").isNull(), F.col("va")).otherwise(op(F.col("va"), F.col("vb"))).alias("v"))


def multi_find(m: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, v) of all keys; v null where the map lacks them."""
    return keys.select("k").join(m, "k", "left")


def key_range(m: DataFrame, lo, hi) -> DataFrame:
    """Keys from lo to hi, both included; a filter that reaches the scan."""
    return m.where(F.col("k").between(lo, hi))


def range_number(m: DataFrame, lo, n: int) -> DataFrame:
    """The first n entries from lo on: the n are the feature."""
    return m.where(F.col("k") >= lo).orderBy("k").limit(n)


def next_keys(m: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, next, previous): strict neighbours of each asked key among the map's, by one sorted pass each way in key ranges.

    Both frames begin at the range's end and grow: a frame that shrinks row by row is folded anew for every row.
    """
    both = ranged(m.select("k", F.lit(False).alias("q")).unionByName(keys.select("k", F.lit(True).alias("q"))), ["k"])
    up, down = Window.partitionBy("__p").orderBy("k"), Window.partitionBy("__p").orderBy(F.desc("k"))
    real = F.when(~F.col("q"), F.col("k"))
    edges = both.groupBy("__p").agg(F.min(real).alias("lo"), F.max(real).alias("hi"))
    before = (Window.unboundedPreceding, -1)
    both = both.withColumn("p", F.max(real).over(up.rangeBetween(*before))).withColumn("n", F.min(real).over(down.rangeBetween(*before))).where("q")
    edges = edges.select("__p", F.min("lo").over(Window.orderBy(F.desc("__p")).rowsBetween(*before)).alias("nn"), F.max("hi").over(Window.orderBy("__p").rowsBetween(*before)).alias("pp"))  # one row a range
    return both.join(F.broadcast(edges), "__p").select("k", F.coalesce("n", "nn").alias("next"), F.coalesce("p", "pp").alias("previous"))


def select_rank(m: DataFrame, i: int) -> DataFrame:
    return m.join(F.broadcast(kth_smallest(m.select(F.col("k").alias("x")), i).withColumnRenamed("x", "k")), "k", "left_semi")  # one row


def aug_range(m: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, total) of ranges (id, lo, hi): sums over keys lo..hi, both included, as differences of prefix sums at both ends.

    Entries and ends are sorted together once, a key's entry after the starts and before the ends that name it.
    """
    used = F.col("hi") >= F.col("lo")
    ends = F.array(*[F.struct(F.col(c).alias("k"), F.lit(kind).alias("kind"), F.when(used, sign).otherwise(0).alias("sign")) for c, kind, sign in (("lo", 0, -1), ("hi", 2, 1))])
    entries = m.select("k", F.lit(1).alias("kind"), F.col("v"))
    placed = ranged(entries.unionByName(ranges.select("id", F.explode(ends).alias("e")).select("id", "e.*"), allowMissingColumns=True), ["k", "kind", "id"])
    ahead = placed.groupBy("__p").agg(F.sum("v").alias("t")).select("__p", F.coalesce(F.sum("t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("v").over(Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    found = placed.withColumn("own", own).where("sign is not null").join(F.broadcast(ahead), "__p")  # one row a range
    return found.groupBy("id").agg(F.sum(F.col("sign") * (F.col("ahead") + F.col("own"))).cast("long").alias("total"))


def map_of(spark, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("v"))


A = "(select o_orderkey as k, cast(floor(o_totalprice) as bigint) as v from orders where o_orderkey % 2 = 0)"
B = "(select o_orderkey as k, cast(o_custkey as bigint) as v from orders where o_orderkey % 3 = 0)"
M = "(select o_orderkey as k, cast(floor(o_totalprice) as bigint) as v from orders)"


def _ab(name: str, sql: str):
    def add(f):
        register(name, sql)(lambda s, d: f(map_of(s, d).where("k % 2 = 0"), table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))))

    return add


def _m(name: str, sql: str):
    def add(f):
        register(name, sql)(lambda s, d: f(map_of(s, d)))

    return add


def _pairs(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"))


register("map_build", "select l_orderkey as k, max(l_partkey) as v from lineitem group by 1")(lambda s, d: build(_pairs(s, d)))
register("map_build_combine", "select l_orderkey as k, cast(sum(l_partkey) as bigint) as v from lineitem group by 1")(lambda s, d: build_combine(_pairs(s, d), F.sum))
register("map_build_reduce", "select l_orderkey as k, list(l_partkey order by l_partkey) as v from lineitem group by 1")(lambda s, d: build_combine(_pairs(s, d), lambda c: F.array_sort(F.collect_list(c))))
_ab("map_union", f"select coalesce(a.k, b.k) as k, case when a.v is null then b.v when b.v is null then a.v else a.v + b.v end as v from {A} a full join {B} b on a.k = b.k")(lambda a, b: union(a, b, lambda x, y: x + y))
_ab("map_intersect", f"select a.k, a.v - b.v as v from {A} a join {B} b on a.k = b.k")(lambda a, b: intersect(a, b, lambda x, y: x - y))
_ab("map_difference", f"select k, v from {A} where k not in (select k from {B})")(difference)
_ab("multi_insert", f"select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v from {A} a full join {B} b on a.k = b.k")(multi_insert)
_ab("multi_insert_combine", f"select coalesce(a.k, b.k) as k, case when a.v is null then b.v when b.v is null then a.v else greatest(a.v, b.v) end as v from {A} a full join {B} b on a.k = b.k")(lambda a, b: union(a, b, F.greatest))
_ab("multi_update", f"select a.k, case when b.v is null then a.v else a.v * 2 + b.v end as v from {A} a left join {B} b on a.k = b.k")(lambda a, b: multi_update(a, b, lambda x, y: 2 * x + y))
_ab("multi_delete", f"select k, v from {A} where k not in (select k from {B})")(difference)
_ab("multi_find", f"select b.k, a.v from {B} b left join {A} a on a.k = b.k")(multi_find)
_m("map_join2", f"select k, v from {M} where k < 500 or k >= 700")(lambda m: m.where("k < 500").unionByName(m.where("k >= 700")))
_m("map_insert", f"select k, case when k = 5 then v + 1 else v end as v from {M}")(lambda m: union(m, m.where("k = 5").select("k", F.lit(1).cast("long").alias("v")), lambda a, b: a + b))
_m("map_update", f"select k, case when k = 7 then -v else v end as v from {M}")(lambda m: m.select("k", F.when(F.col("k") == 7, -F.col("v")).otherwise(F.col("v")).alias("v")))
_m("map_remove", f"select k, v from {M} where k <> 7")(lambda m: m.where("k <> 7"))
_m("map_find", f"select k, v from {M} where k = 11")(lambda m: m.where("k = 11"))
_m("map_size", f"select count(*) as n, count(*) = 0 as empty from {M}")(lambda m: m.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("empty")))
_m("map_range", f"select k, v from {M} where k between 100 and 300")(lambda m: key_range(m, 100, 300))
_m("range_number", f"select k, v from {M} where k >= 50 order by k limit 20")(lambda m: range_number(m, 50, 20))
_m("range_number_mr", f"select sum(v) as total from (select v from {M} where k >= 50 order by k limit 20)")(lambda m: range_number(m, 50, 20).agg(F.sum("v").alias("total")))
_m("up_to", f"select k, v from {M} where k <= 99")(lambda m: m.where("k <= 99"))
_m("down_to", f"select k, v from {M} where k >= 99")(lambda m: m.where("k >= 99"))
_m("next_previous", f"select b.k, (select min(k) from {M} where k % 5 = 0 and k > b.k) as next, (select max(k) from {M} where k % 5 = 0 and k < b.k) as previous from {M} b where b.k % 7 = 3 and b.k < 2000")(lambda m: next_keys(m.where("k % 5 = 0"), m.where("k % 7 = 3 and k < 2000").select("k")))
_m("next_previous_all", f"select k, lead(k) over (order by k) as next, lag(k) over (order by k) as previous from {M}")(lambda m: next_keys(m, m.select("k")))
_m("key_rank", f"select count(*) filter (k < 77) as rank from {M}")(lambda m: m.agg(F.count_if(F.col("k") < 77).alias("rank")))
_m("key_select", f"select k, v from {M} order by k limit 1 offset 42")(lambda m: select_rank(m, 42))
_m("map_last", f"select k, v from {M} order by k desc limit 1")(lambda m: m.agg(F.max(F.struct("k", "v")).alias("e")).select("e.k", "e.v"))
_m("map_take", f"select k, v from {M} order by k limit 10")(lambda m: m.orderBy("k").limit(10))
_m("map_filter", f"select k, v from {M} where v > 200000")(lambda m: m.where("v > 200000"))
_m("map_map", f"select k, v * 2 as v from {M}")(lambda m: m.select("k", (F.col("v") * 2).alias("v")))
_m("map_map_filter", f"select k, v // 2 as v from {M} where v % 2 = 0")(lambda m: m.where("v % 2 = 0").select("k", F.expr("v div 2").alias("v")))
_m("map_index", f"select row_number() over (order by k) - 1 as idx, k, v from {M}")(lambda m: dense(m, ["k"]).select("idx", "k", "v"))
_m("map_reduce", f"select sum(v * 2) as total from {M}")(lambda m: m.agg(F.sum(F.col("v") * 2).alias("total")))
_m("if_exist", f"select bool_or(v > 400000) as found from {M}")(lambda m: m.agg(F.bool_or(F.expr("v > 400000")).alias("found")))
_m("map_keys_values", f"select k, v from {M}")(lambda m: m.select("k", "v"))
_m("aug_val", f"select max(v) as aug from {M}")(lambda m: m.agg(F.max("v").alias("aug")))
_m("aug_left", f"select k, max(v) over (order by k) as aug from {M}")(lambda m: scan(m.toDF("idx", "x"), "max", True).select(F.col("idx").alias("k"), F.col("prefix").alias("aug")))
_m("aug_right", f"select k, cast((select sum(v) from {M}) - sum(v) over (order by k) + v as bigint) as aug from {M}")(lambda m: scan(m.toDF("idx", "x")).crossJoin(F.broadcast(m.agg(F.sum("v").alias("s")))).select(F.col("idx").alias("k"), (F.col("s") - F.col("prefix")).alias("aug")))
_m("aug_range", f"select r.k as id, cast(sum(m.v) as bigint) as total from {M} r join {M} m on m.k between r.k and r.k + 20 where r.k % 50 = 0 group by r.k")(lambda m: aug_range(m, m.where("k % 50 = 0").select(F.col("k").alias("id"), F.col("k").alias("lo"), (F.col("k") + 20).alias("hi"))))
_m("aug_range_all", f"select k as id, cast(sum(v) over (order by k range between current row and 20 following) as bigint) as total from {M}")(lambda m: aug_range(m, m.select(F.col("k").alias("id"), F.col("k").alias("lo"), (F.col("k") + 20).alias("hi"))))
_m("aug_filter", f"select k, v from {M} where v >= 300000")(lambda m: m.where("v >= 300000"))
_m("aug_select", f"select min(k) as k from (select k, sum(v) over (order by k) as s from {M}) where s > 5000000")(lambda m: scan(m.toDF("idx", "x"), inclusive=True).where("prefix > 5000000").agg(F.min("idx").alias("k")))
