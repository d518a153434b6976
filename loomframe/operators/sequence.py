"""Sequence primitives: a sequence is a DataFrame (idx, x) whose order is ``idx``, dense from 0.

Order is data here, never row order. Prefix operators work in two levels: a
window inside blocks of ``BLOCK`` positions, and one over the blocks' totals,
so no task sees more than a block and the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed, hashed_sql
from ..registry import register
from ..tables import stored, table

BLOCK = 1 << 18
#: monoids: (aggregate, identity, combination of two columns)
Monoid = tuple[Callable, object, Callable]
MONOIDS: dict[str, Monoid] = {
    "plus": (F.sum, 0, lambda a, b: a + b),
    "min": (F.min, (1 << 63) - 1, F.least),
    "max": (F.max, -(1 << 63), F.greatest),
    "and": (F.bit_and, -1, lambda a, b: a.bitwiseAND(b)),
    "or": (F.bit_or, 0, lambda a, b: a.bitwiseOR(b)),
    "xor": (F.bit_xor, 0, lambda a, b: a.bitwiseXOR(b)),
}


def reduce(seq: DataFrame, monoid: str = "plus") -> DataFrame:
    """(total): the fold of all elements; the identity if there is none."""
    f, zero, _ = MONOIDS[monoid]
    return seq.agg(F.coalesce(f("x").cast("long"), F.lit(zero).cast("long")).alias("total"))


def _blocked(seq: DataFrame, order: str = "idx") -> DataFrame:
    return seq.withColumn("__b", F.floor(F.col(order) / BLOCK))


def scan(seq: DataFrame, monoid: str = "plus", inclusive: bool = False) -> DataFrame:
    """(idx, x, prefix): the fold of all earlier elements, with the own one if ``inclusive``."""
    f, zero, both = MONOIDS[monoid]
    zero = F.lit(zero).cast("long")
    b = _blocked(seq)
    ahead = b.groupBy("__b").agg(f("x").cast("long").alias("__t"))
    ahead = ahead.select("__b", F.coalesce(f("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).cast("long"), zero).alias("__ahead"))
    inside = Window.partitionBy("__b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = F.coalesce(f("x").over(inside).cast("long"), zero)
    return b.withColumn("__own", own).join(ahead, "__b").select("idx", "x", both(F.col("__ahead"), F.col("__own")).cast("long").alias("prefix"))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in sorted ranges of the columns ``order``: __p numbers the range, __m grows in it by one from __p * 2**33."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    return stored(placed).withColumn("__p", F.shiftright("__m", 33))  # the id's upper bits are the partition, its lower 33 the row in it


def dense(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with idx, its dense position from 0 in the total order of the columns ``order``.

    One shuffle into ranges of all these columns, so that a frequent value of
    the first is split by the others; the sorted ranges are written with each row's
    place in its range, then shifted by the counts of the ranges before.
    """
    placed = ranged(df, order)
    ahead = placed.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return placed.join(F.broadcast(ahead), "__p").withColumn("idx", (F.col("__ahead") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__p", "__m", "__ahead")  # one row a range


def pack(seq: DataFrame, flag: Column) -> DataFrame:
    """The elements whose flag is true, with new dense positions by way of an exclusive scan of the flags."""
    marked = seq.withColumn("__keep", flag)
    at = scan(marked.select("idx", F.col("__keep").cast("long").alias("x"))).select("idx", F.col("prefix").alias("at"))
    return marked.where("__keep").join(at, "idx").select(F.col("at").alias("idx"), "x")


def pack_index(seq: DataFrame, flag: Column) -> DataFrame:
    return seq.where(flag).select("idx")


def neighbours(seq: DataFrame, offset: int = -1) -> DataFrame:
    """(idx, x, other): each element with the one ``offset`` places away, by a join on positions."""
    other = seq.select((F.col("idx") - offset).alias("idx"), F.col("x").alias("other"))
    return seq.join(other, "idx", "left")


def first_where(seq: DataFrame, p: Column) -> DataFrame:
    """(idx): the first position where ``p`` holds, the length if nowhere."""
    return seq.agg(F.coalesce(F.min(F.when(p, F.col("idx"))), F.count("*")).alias("idx"))


def find_first_of(seq: DataFrame, values: DataFrame) -> DataFrame:
    n = seq.agg(F.count("*").alias("n"))
    return seq.join(values.select("x").distinct(), "x", "left_semi").agg(F.min("idx").alias("i")).crossJoin(F.broadcast(n)).select(F.coalesce("i", "n").alias("idx"))  # one row each


def adjacent_find(seq: DataFrame) -> DataFrame:
    """(idx): the first position whose element equals the next, the length if none."""
    return first_where(neighbours(seq, 1), F.col("x") == F.col("other"))


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx): the first position where the two differ or one ends; null if they are equal."""
    both = a.select("idx", F.col("x").alias("xa")).join(b.select("idx", F.col("x").alias("xb")), "idx", "full")
    return both.where(~F.col("xa").eqNullSafe(F.col("xb"))).agg(F.min("idx").alias("idx"))


def search(seq: DataFrame, pattern: list) -> DataFrame:
    """(idx): all positions where ``pattern`` begins; every pattern place is one equi-join on shifted positions."""
    hits = None
    for j, v in enumerate(pattern):
        own = seq.where(F.col("x") == v).select((F.col("idx") - j).alias("idx"))
        hits = own if hits is None else hits.join(own, "idx", "left_semi")
    return hits.where("idx >= 0")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return mismatch(a, b).select(F.col("idx").isNull().alias("equal"))


def lexicographical_less(a: DataFrame, b: DataFrame) -> DataFrame:
    """(less): whether a comes before b; a proper prefix does."""
    both = a.select("idx", F.col("x").alias("xa")).join(b.select("idx", F.col("x").alias("xb")), "idx", "full").where(~F.col("xa").eqNullSafe(F.col("xb")))
    first = both.agg(F.min_by(F.struct("xa", "xb"), "idx").alias("d"))
    return first.select(F.coalesce(F.col("d.xa").isNull() & F.col("d.xb").isNotNull() | (F.col("d.xa") < F.col("d.xb")), F.lit(False)).alias("less"))


def unique(seq: DataFrame) -> DataFrame:
    """(idx, x): elements unlike their predecessor."""
    return neighbours(seq, -1).where((F.col("idx") == 0) | ~F.col("x").eqNullSafe(F.col("other"))).select("idx", "x")


def minmax_element(seq: DataFrame) -> DataFrame:
    """(min_idx, max_idx): first positions of the extremes."""
    return seq.agg(F.min(F.struct("x", "idx"))["idx"].alias("min_idx"), (-F.max(F.struct("x", (-F.col("idx")).alias("idx")))["idx"]).alias("max_idx"))


def reverse(seq: DataFrame) -> DataFrame:
    n = seq.agg(F.count("*").alias("n"))
    return seq.crossJoin(F.broadcast(n)).select((F.col("n") - 1 - F.col("idx")).alias("idx"), "x")  # one row


def rotate(seq: DataFrame, t: int) -> DataFrame:
    """out[i] = in[(i + t) mod n]."""
    n = seq.agg(F.count("*").alias("n"))
    return seq.crossJoin(F.broadcast(n)).select(F.pmod(F.col("idx") - t, F.col("n")).alias("idx"), "x")


def is_sorted_until(seq: DataFrame) -> DataFrame:
    """(idx): the first position smaller than its predecessor, the length if sorted."""
    return first_where(neighbours(seq, -1), F.col("x") < F.col("other"))


def is_sorted(seq: DataFrame) -> DataFrame:
    return neighbours(seq, -1).agg(F.coalesce(F.bool_and(F.coalesce(F.col("x") >= F.col("other"), F.lit(True))), F.lit(True)).alias("sorted"))


def is_partitioned(seq: DataFrame, p: Column) -> DataFrame:
    got = seq.agg(F.max(F.when(p, F.col("idx"))).alias("t"), F.min(F.when(~p, F.col("idx"))).alias("f"))
    return got.select(F.coalesce(F.col("t") < F.col("f"), F.lit(True)).alias("partitioned"))


def rank(seq: DataFrame) -> DataFrame:
    """(idx, rank): 0-based place in stable order."""
    return dense(seq.select(F.col("x"), F.col("idx").alias("at")), ["x", "at"]).select(F.col("at").alias("idx"), F.col("idx").alias("rank"))


def kth_smallest(seq: DataFrame, k: int, few: int = 1 << 20) -> DataFrame:
    """(x): the element of 0-based place k, none beyond the end.

    A bracket of approximate quantiles around the place, counted exactly, shrinks the
    rows to a few hundredths a pass until ``few`` are left to sort.
    """
    live, margin = seq.select("x"), 0.002
    while True:
        n = live.count()
        if n <= few or not 0 <= k < n:
            return live.orderBy("x").offset(k).limit(1)
        lo, hi = live.agg(F.percentile_approx("x", F.array(F.lit(max(0.0, k / n - margin)), F.lit(min(1.0, (k + 1) / n + margin))), 5000).alias("q")).first()[0]
        below, inside = live.agg(F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi))).first()
        if not below <= k < below + inside:
            margin *= 4
        elif lo == hi:
            return seq.where(F.col("x") == lo).select("x").limit(1)
        elif inside == n:  # too few different values for a closer bracket: count them
            upto = live.groupBy("x").count().withColumn("upto", F.sum("count").over(Window.orderBy("x")))
            return upto.where(F.col("upto") > k).orderBy("x").limit(1).select("x")
        else:
            live, k = live.where(F.col("x").between(lo, hi)), k - below


def approximate_kth_smallest(seq: DataFrame, k: int, accuracy: int = 10000) -> DataFrame:
    """(x): an element whose place is at most n / ``accuracy`` from k, in one pass of bounded summaries."""
    n = max(1, seq.count())
    return seq.agg(F.percentile_approx("x", min(1.0, (k + 1) / n), accuracy).alias("x"))


def place_errors(seq: DataFrame, places: int, accuracy: int) -> DataFrame:
    """(k, close): for k at ``places`` - 1 even steps, whether the approximate element's place is as near as promised."""
    n = seq.count()
    out = None
    for i in range(1, places):
        k = i * n // places
        x = approximate_kth_smallest(seq, k, accuracy)
        at = seq.join(F.broadcast(x.withColumnRenamed("x", "y")), F.col("x") <= F.col("y")).agg(F.count("*").alias("upto"), F.count_if(F.col("x") < F.col("y")).alias("below"))  # one row
        own = at.select(F.lit(k).cast("long").alias("k"), ((F.col("below") <= k + n / accuracy + 1) & (F.col("upto") > k - n / accuracy - 1)).alias("close"))
        out = own if out is None else out.unionByName(own)
    return out


def counting_sort(seq: DataFrame, key: Column) -> DataFrame:
    """(key, start, count): the places of each bucket in the stably sorted sequence."""
    counts = seq.groupBy(key.cast("long").alias("key")).agg(F.count("*").alias("count"))
    return counts.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.count("*").alias("n"))
    return a.select("idx", "x").unionByName(b.crossJoin(F.broadcast(n)).select((F.col("idx") + F.col("n")).alias("idx"), "x"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted sequences as one: ties take ``a`` first."""
    both = a.select("x", F.lit(0).alias("s"), F.col("idx").alias("i")).unionByName(b.select("x", F.lit(1).alias("s"), F.col("idx").alias("i")))
    return dense(both, ["x", "s", "i"]).select("idx", "x")


def zip_with(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    both = a.select("idx", F.col("x").alias("xa")).join(b.select("idx", F.col("x").alias("xb")), "idx")
    return both.select("idx", f(F.col("xa"), F.col("xb")).alias("x"))


def split_at(seq: DataFrame, flag: Column) -> DataFrame:
    """(piece, idx, x): pieces end after each flagged element."""
    marked = seq.withColumn("__f", flag.cast("long"))
    piece = scan(marked.select("idx", F.col("__f").alias("x"))).select("idx", F.col("prefix").alias("piece"))
    return marked.join(piece, "idx").select("piece", "idx", "x")


def tokens(texts: DataFrame, text_col: str = "text", separators: str = r"[\s]+") -> DataFrame:
    """(id, pos, token) of rows (id, text): maximal runs that do not separate."""
    return texts.select("id", F.posexplode(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), separators), lambda t: t != "")).alias("pos", "token"))


def iota(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.col("id").alias("x"))


def tabulate(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), f(F.col("id")).alias("x"))


def random_shuffle(seq: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation of the sequence that depends on the seed only."""
    keyed = seq.select(hashed(F.col("idx"), seed=seed).alias("h"), F.col("idx").alias("i"), "x")
    return dense(keyed, ["h", "i"]).select("idx", "x")


def write_combine(writes: DataFrame, how: str) -> DataFrame:
    """(target, x): concurrent priority writes (target, x) resolved by min, max or plus."""
    return writes.groupBy("target").agg(MONOIDS[how][0]("x").cast("long").alias("x"))


def flatten(nested: DataFrame) -> DataFrame:
    """(idx, x) of rows (idx, xs): all inner elements in order."""
    sizes = scan(nested.select("idx", F.size("xs").cast("long").alias("x"))).select("idx", "prefix")
    return nested.join(sizes, "idx").select("prefix", F.posexplode("xs").alias("j", "x")).select((F.col("prefix") + F.col("j")).alias("idx"), "x")


def seq_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order totals by order key."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").cast("long").alias("x"))


S = "(select o_orderkey as idx, cast(floor(o_totalprice) as bigint) as x from orders)"
_N = "(select count(*) from orders)"


def _seq(name: str, sql: str | None):
    """Registers a query on the order-total sequence."""

    def add(f: Callable[[DataFrame], DataFrame]):
        register(name, sql)(lambda spark, d: f(seq_of(spark, d)))
        return f

    return add


for _m, _sql in {"plus": "sum", "min": "min", "max": "max", "and": "bit_and", "or": "bit_or", "xor": "bit_xor"}.items():
    _seq(f"reduce_{_m}", f"select cast({_sql}(x) as bigint) as total from {S}")(lambda s, m=_m: reduce(s, m))
_seq("scan_exclusive", f"select idx, x, cast(coalesce(sum(x) over (order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix from {S}")(scan)
_seq("scan_inclusive", f"select idx, x, cast(sum(x) over (order by idx) as bigint) as prefix from {S}")(lambda s: scan(s, inclusive=True))
_seq("scan_max", f"select idx, x, max(x) over (order by idx) as prefix from {S}")(lambda s: scan(s, "max", True))
_even = lambda c="x": F.col(c) % 2 == 0
_seq("pack", f"select row_number() over (order by idx) - 1 as idx, x from {S} where x % 2 = 0")(lambda s: pack(s, _even()))
_seq("pack_index", f"select idx from {S} where x % 2 = 0")(lambda s: pack_index(s, _even()))
_seq("pack_into_count", f"select count(*) as n from {S} where x % 2 = 0")(lambda s: s.where(_even()).agg(F.count("*").alias("n")))
_seq("seq_filter", f"select idx, x from {S} where x > 100000")(lambda s: s.where("x > 100000"))
_seq("remove_if", f"select idx, x from {S} where not x % 2 = 0")(lambda s: s.where(~_even()))
_seq("remove_value", f"select idx, x from {S} where x <> (select min(x) from {S})")(lambda s: s.join(F.broadcast(s.agg(F.min("x").alias("x"))), "x", "left_anti").select("idx", "x"))
_seq("seq_map", f"select idx, 2 * x + 1 as y from {S}")(lambda s: s.select("idx", (2 * F.col("x") + 1).alias("y")))
_seq("filter_map", f"select idx, x // 2 as y from {S} where x % 2 = 0")(lambda s: s.where(_even()).select("idx", F.expr("x div 2").alias("y")))
_seq("map_maybe", f"select idx, case when x % 3 = 0 then x // 3 end as y from {S} where x % 3 = 0")(lambda s: s.select("idx", F.when(F.col("x") % 3 == 0, F.expr("x div 3")).alias("y")).where("y is not null"))
_seq("count_if", f"select count(*) filter (x % 2 = 0) as n from {S}")(lambda s: s.agg(F.count_if(_even()).alias("n")))
_seq("quantifiers", f"select bool_and(x > 0) as all_of, bool_or(x > 400000) as any_of, not bool_or(x < 0) as none_of from {S}")(lambda s: s.agg(F.bool_and(F.expr("x > 0")).alias("all_of"), F.bool_or(F.expr("x > 400000")).alias("any_of"), (~F.bool_or(F.expr("x < 0"))).alias("none_of")))
_seq("find_if", f"select coalesce(min(idx) filter (x > 300000), count(*)) as idx from {S}")(lambda s: first_where(s, F.col("x") > 300000))
_seq("find_if_not", f"select coalesce(min(idx) filter (not x > 1000), count(*)) as idx from {S}")(lambda s: first_where(s, ~(F.col("x") > 1000)))
_seq("find_first_of", f"select coalesce((select min(idx) from {S} where x in (select distinct cast(floor(o_totalprice) as bigint) from orders where o_orderkey % 97 = 5)), {_N}) as idx")(lambda s: find_first_of(s, s.where("idx % 97 = 5")))
_NEXT = f"(select idx, x, lead(x) over (order by idx) as nx, lag(x) over (order by idx) as px from {S})"
_seq("adjacent_find", f"select coalesce(min(idx) filter (x = nx), count(*)) as idx from {_NEXT}")(adjacent_find)
_seq("seq_unique", f"select idx, x from (select idx, x // 50000 as x, lag(x // 50000) over (order by idx) as p from {S}) where p is null or p <> x")(lambda s: unique(s.select("idx", F.expr("x div 50000").alias("x"))))
_seq("is_sorted", f"select coalesce(bool_and(x >= px), true) as sorted from {_NEXT} where px is not null")(is_sorted)
_seq("is_sorted_until", f"select coalesce(min(idx) filter (x < px), count(*)) as idx from {_NEXT}")(is_sorted_until)
_seq("is_partitioned", f"select coalesce(max(idx) filter (x % 2 = 0) < min(idx) filter (x % 2 <> 0), true) as partitioned from {S}")(lambda s: is_partitioned(s, _even()))
_seq("minmax_element", f"select (select min(idx) from {S} where x = (select min(x) from {S})) as min_idx, (select min(idx) from {S} where x = (select max(x) from {S})) as max_idx")(minmax_element)
_seq("reverse", f"select {_N} - 1 - idx as idx, x from {S}")(reverse)
_seq("rotate", f"select (idx - 7 + {_N}) % {_N} as idx, x from {S}")(lambda s: rotate(s, 7))
_seq("stable_rank", f"select idx, row_number() over (order by x, idx) - 1 as rank from {S}")(rank)
_seq("kth_smallest", f"select x from {S} order by x, idx limit 1 offset 100")(lambda s: kth_smallest(s, 100))
_seq("kth_smallest_in_passes", f"select x from {S} order by x, idx limit 1 offset 700")(lambda s: kth_smallest(s, 700, few=64))
_seq("approximate_kth_smallest", f"select (i * {_N}) // 6 as k, true as close from range(1, 6) t(i)")(lambda s: place_errors(s, 6, 50))
_seq("sort", f"select row_number() over (order by x, idx) - 1 as idx, x from {S}")(lambda s: dense(s.select("x", F.col("idx").alias("i")), ["x", "i"]).select("idx", "x"))
_seq("counting_sort", f"select key, count(*) as count, coalesce(sum(count(*)) over (order by key rows between unbounded preceding and 1 preceding), 0) as start from (select x % 64 as key from {S}) group by key")(lambda s: counting_sort(s, F.col("x") % 64))
_seq("merge", f"select row_number() over (order by x, s, i) - 1 as idx, x from (select x, idx % 2 as s, idx as i from {S})")(lambda s: merge(s.where("idx % 2 = 0"), s.where("idx % 2 = 1")))
_seq("append", f"select idx, x from {S} union all select idx + {_N}, x from {S}")(lambda s: append(s, s))
_seq("zip_with", f"select idx, x + idx as x from {S}")(lambda s: zip_with(s, s.select("idx", F.col("idx").alias("x")), lambda a, b: a + b))
_seq("mismatch", f"select min(idx) as idx from {S} where idx % 100 = 99")(lambda s: mismatch(s, s.select("idx", F.when(F.col("idx") % 100 == 99, -1).otherwise(F.col("x")).alias("x"))))
_D = f"(select a.idx, a.x, case when a.idx % 100 = 99 then -1 else a.x end as y from {S} a)"
_seq("seq_equal", f"select 'copy' as other, count(*) filter (x <> x) = 0 as equal from {_D} union all select 'changed', count(*) filter (x <> y) = 0 from {_D} union all select 'shorter', count(*) = count(*) filter (idx > 0) from {_D}")(
    lambda s: equal(s, s).withColumn("other", F.lit("copy"))
    .unionByName(equal(s, s.select("idx", F.when(F.col("idx") % 100 == 99, -1).otherwise(F.col("x")).alias("x"))).withColumn("other", F.lit("changed")))
    .unionByName(equal(s, s.where("idx > 0")).withColumn("other", F.lit("shorter")))
)
_seq("lexicographical_compare", f"select coalesce((select x < -1 from {S} where idx = 99), false) as less")(lambda s: lexicographical_less(s, s.select("idx", F.when(F.col("idx") % 100 == 99, -1).otherwise(F.col("x")).alias("x"))))
_M = f"(select idx, x % 3 as x from {S})"
_M3 = f"(select idx, x, lead(x) over (order by idx) as y, lead(x, 2) over (order by idx) as z from {_M})"
_seq("search_all", f"select idx from {_M3} where x = 0 and y = 1 and z = 2")(lambda s: search(s.select("idx", (F.col("x") % 3).alias("x")), [0, 1, 2]))
_seq("search", f"select min(idx) as idx from {_M3} where x = 0 and y = 1 and z = 2")(lambda s: search(s.select("idx", (F.col("x") % 3).alias("x")), [0, 1, 2]).agg(F.min("idx").alias("idx")))
_seq("find_end", f"select max(idx) as idx from {_M3} where x = 0 and y = 1 and z = 2")(lambda s: search(s.select("idx", (F.col("x") % 3).alias("x")), [0, 1, 2]).agg(F.max("idx").alias("idx")))
_seq("split_at", f"select coalesce(sum(case when x % 10 = 0 then 1 else 0 end) over (order by idx rows between unbounded preceding and 1 preceding), 0) as piece, idx, x from {S}")(lambda s: split_at(s, F.col("x") % 10 == 0))
_seq("map_split_at", f"select piece, sum(x) as total from (select coalesce(sum(case when x % 10 = 0 then 1 else 0 end) over (order by idx rows between unbounded preceding and 1 preceding), 0) as piece, x from {S}) group by piece")(lambda s: split_at(s, F.col("x") % 10 == 0).groupBy("piece").agg(F.sum("x").alias("total")))
_seq("write_min", f"select idx % 100 as target, min(x) as x from {S} group by 1")(lambda s: write_combine(s.select((F.col("idx") % 100).alias("target"), "x"), "min"))
_seq("write_add", f"select idx % 100 as target, cast(sum(x) as bigint) as x from {S} group by 1")(lambda s: write_combine(s.select((F.col("idx") % 100).alias("target"), "x"), "plus"))
_seq("remove_duplicates_ordered", f"select distinct x % 1000 as x from {S} order by x")(lambda s: s.select((F.col("x") % 1000).alias("x")).distinct().orderBy("x"))
_seq("flatten", f"select 3 * idx + j as idx, x + j as x from {S}, range(3) t(j)")(lambda s: flatten(s.select("idx", F.expr("transform(sequence(0L, 2L), j -> x + j)").alias("xs"))))
_seq("enumerate", f"select idx as i, x from {S}")(lambda s: s.select(F.col("idx").alias("i"), "x"))
_seq("mcss", f"select max(p - m) as best from (select p, min(q) over (order by idx) as m from (select idx, sum(x - 150000) over (order by idx) as p, sum(x - 150000) over (order by idx) - (x - 150000) as q from {S}))")(
    lambda s: scan(scan(s.select("idx", (F.col("x") - 150000).alias("x")), inclusive=True).select("idx", (F.col("prefix") - F.col("x")).alias("x"), "prefix").select("idx", "x"), "min", True)
    .select("idx", F.col("prefix").alias("least")).join(scan(s.select("idx", (F.col("x") - 150000).alias("x")), inclusive=True), "idx").agg(F.max(F.col("prefix") - F.col("least")).alias("best"))
)
register("iota", "select i as idx, i as x from range(1000) t(i)")(lambda spark, d: iota(spark, 1000))
register("tabulate", "select i as idx, i * i as x from range(1000) t(i)")(lambda spark, d: tabulate(spark, 1000, lambda i: i * i))
register("tokens", r"select id, pos, token from (select doc_id as id, unnest(list_filter(string_split_regex(text, '[\s]+'), lambda t: t <> '')) as token, unnest(range(len(list_filter(string_split_regex(text, '[\s]+'), lambda t: t <> '')))) as pos from documents)")(
    lambda spark, d: tokens(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
)
register("map_tokens", r"select id, sum(length(token)) as chars from (select doc_id as id, unnest(list_filter(string_split_regex(text, '[\s]+'), lambda t: t <> '')) as token from documents) group by id")(
    lambda spark, d: tokens(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("id").agg(F.sum(F.char_length("token")).alias("chars"))
)
register("random_shuffle", f"select row_number() over (order by {hashed_sql('idx', seed=42)}, idx) - 1 as idx, x from {S}")(lambda spark, d: random_shuffle(seq_of(spark, d), 42))
register("random_permutation", f"select row_number() over (order by {hashed_sql('i', seed=7)}, i) - 1 as idx, i as x from range(10000) t(i)")(lambda spark, d: random_shuffle(iota(spark, 10000), 7))
