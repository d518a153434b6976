"""Generators: every value is a hash of (seed, position), so rows come out the same on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hashed, hashed_sql, uniform, uniform_sql
from ..registry import register


def rmat(spark: SparkSession, scale: int, m: int, a: float = 0.5, b: float = 0.1, c: float = 0.1, seed: int = 1) -> DataFrame:
    """(src, dst) of m edges over 2**scale vertices: each bit of the ends is drawn by quadrant."""
    src = dst = F.lit(0).cast("long")
    for i in range(scale):
        u = uniform(F.col("id"), F.lit(i), seed=seed)
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when((u >= a) & (u < a + b) | (u >= a + b + c), 1).otherwise(0)
    return spark.range(m).select(src.alias("src"), dst.alias("dst"))


def grid(spark: SparkSession, side: int, dims: int = 2) -> DataFrame:
    """(src, dst) of a mesh that wraps around, one edge forward in each dimension."""
    n = side**dims
    step = F.explode(F.array(*[F.lit(side**k).cast("long") for k in range(dims)])).alias("s")
    v = spark.range(n).select("id", step)
    place = F.expr("id div s") % side
    return v.select(F.col("id").alias("src"), (F.col("id") + F.col("s") * (F.pmod(place + 1, F.lit(side)) - place)).alias("dst"))


def local_graph(spark: SparkSession, n: int, degree: int, dims: int = 2, seed: int = 1) -> DataFrame:
    """(src, dst): random edges whose length follows a power law, as in ``dims`` dimensions."""
    e = spark.range(n * degree).select(F.expr(f"id div {degree}").alias("src"), "id")
    span = F.pow(uniform(F.col("id"), seed=seed) + 1e-9, F.lit(-1.0 / dims))
    return e.select("src", F.pmod(F.col("src") + F.ceil(span).cast("long"), F.lit(n)).alias("dst"))


def hypergraph(spark: SparkSession, nv: int, nh: int, cardinality: int, seed: int = 1) -> DataFrame:
    """(v, h): each hyperedge draws ``cardinality`` vertices; repeats fall together."""
    return spark.range(nh * cardinality).select((hashed(F.col("id"), seed=seed) % nv).alias("v"), F.expr(f"id div {cardinality}").alias("h")).distinct()


def with_weights(e: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Integer weights from 1 to log2 n."""
    return e.withColumn("w", 1 + hashed(*[F.col(c) for c in e.columns], seed=seed) % max(1, int(math.log2(n))))


def with_double_weights(e: DataFrame, seed: int = 1) -> DataFrame:
    return e.withColumn("w", uniform(*[F.col(c) for c in e.columns], seed=seed))


def random_sequence(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 1) -> DataFrame:
    """(idx, x): uniform numbers below n, exponentially distributed ones, or an almost sorted sequence."""
    u = uniform(F.col("id"), seed=seed)
    x = {"uniform": F.floor(u * n), "exponential": F.floor(F.pow(F.lit(float(n)), u)), "almost_sorted": F.when(u < 0.01, F.floor(uniform(F.col("id"), seed=seed + 1) * n)).otherwise(F.col("id"))}[kind]
    return spark.range(n).select(F.col("id").alias("idx"), x.cast("long").alias("x"))


def field(spark: SparkSession, kind: str, n: int, m: int = 1, coupling: float = 2.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a binary random field for belief propagation: ising or potts on an n x m grid, a random tree, or the deterministic tree of n nodes."""
    both = lambda e: e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t00", F.col("t10").alias("t01"), F.col("t01").alias("t10"), "t11"))
    if kind in ("ising", "potts"):
        ids = spark.range(n * m)
        l1 = (uniform(F.col("id"), seed=seed) - 0.5) * coupling
        nodes = ids.select("id", (-l1).alias("l0"), l1.alias("l1"))
        right = ids.where((F.col("id") + 1) % m != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        down = ids.where(F.col("id") < (n - 1) * m).select(F.col("id").alias("src"), (F.col("id") + m).alias("dst"))
        j = (uniform(F.col("src"), F.col("dst"), seed=seed + 1) - 0.5) * coupling
        other = -j if kind == "ising" else F.lit(0.0)
        edges = right.unionByName(down).select("src", "dst", j.alias("t00"), other.alias("t01"), other.alias("t10"), j.alias("t11"))
        return nodes, both(edges)
    ids = spark.range(n)
    child = spark.range(1, n)
    if kind == "random_tree":
        nodes = ids.select("id", F.log(uniform(F.col("id"), seed=seed) + 0.01).alias("l0"), F.log(uniform(F.col("id"), seed=seed + 1) + 0.01).alias("l1"))
        j = (uniform(F.col("id"), seed=seed + 2) - 0.5) * coupling
        edges = child.select(F.floor(uniform(F.col("id"), seed=seed + 3) * F.col("id")).alias("src"), F.col("id").alias("dst"), j.alias("t00"), (-j).alias("t01"), (-j).alias("t10"), j.alias("t11"))
        return nodes, both(edges)
    # the root is (0.1, 0.9) and every edge copies, so every belief is 0.1
    root = F.col("id") == 0
    nodes = ids.select("id", F.when(root, math.log(0.1)).otherwise(math.log(0.5)).alias("l0"), F.when(root, math.log(0.9)).otherwise(math.log(0.5)).alias("l1"))
    edges = child.select(F.expr("(id - 1) div 2").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("t00"), F.lit(-60.0).alias("t01"), F.lit(-60.0).alias("t10"), F.lit(0.0).alias("t11"))
    return nodes, both(edges)


def workload(spark: SparkSession, n: int, buckets: int, kind: str = "flat", seed: int = 1) -> DataFrame:
    """(idx, bucket): priorities drawn flat, by cubes or by halving weights."""
    weights = {"flat": [1.0] * buckets, "cubic": [(i + 1.0) ** 3 for i in range(buckets)], "exponential": [2.0**-i for i in range(buckets)]}[kind]
    total, upto, bucket, u = sum(weights), 0.0, F.lit(buckets - 1), uniform(F.col("id"), seed=seed)
    for i, w in reversed(list(enumerate(weights))):
        upto = sum(weights[: i + 1]) / total
        bucket = F.when(u < upto, i).otherwise(bucket)
    return spark.range(n).select(F.col("id").alias("idx"), bucket.alias("bucket"))


def _belief(s, d):
    from ..operators.analytics import belief_propagation

    return belief_propagation(*field(s, "tree", 15)).select("id", F.round("p0", 6).alias("p0"))


register("grid_graph", "select i as src, (i // 30) * 30 + (i % 30 + 1) % 30 as dst from range(900) t(i) union all select i, (i + 30) % 900 from range(900) t(i)")(lambda s, d: grid(s, 30))
register("grid_graph_3d", "select i as src, (i // 10) * 10 + (i % 10 + 1) % 10 as dst from range(1000) t(i) union all select i, (i // 100) * 100 + (i + 10) % 100 from range(1000) t(i) union all select i, (i + 100) % 1000 from range(1000) t(i)")(lambda s, d: grid(s, 10, 3))
_BITS = ", ".join(f"{uniform_sql('id', str(i), seed=1)} as u{i}" for i in range(10))
_SRC = " + ".join(f"{512 >> i} * (case when u{i} >= {0.5 + 0.1!r}e0 then 1 else 0 end)" for i in range(10))
_DST = " + ".join(f"{512 >> i} * (case when u{i} >= 0.5e0 and u{i} < {0.5 + 0.1!r}e0 or u{i} >= {0.5 + 0.1 + 0.1!r}e0 then 1 else 0 end)" for i in range(10))
_MESH = "(select i as src, (i // 20) * 20 + (i % 20 + 1) % 20 as dst from range(400) t(i) union all select i, (i + 20) % 400 from range(400) t(i))"
register("rmat_graph", f"select {_SRC} as src, {_DST} as dst from (select {_BITS} from range(5000) t(id))")(lambda s, d: rmat(s, 10, 5000))
register("local_graph", f"select id // 5 as src, (id // 5 + cast(ceil(pow({uniform_sql('id', seed=1)} + 1e-9, -0.5e0)) as bigint)) % 1000 as dst from range(5000) t(id)")(lambda s, d: local_graph(s, 1000, 5))
register("random_hypergraph", f"select distinct {hashed_sql('id', seed=1)} % 500 as v, id // 5 as h from range(1000) t(id)")(lambda s, d: hypergraph(s, 500, 200, 5))
register("weighted_hypergraph", f"select v, h, 1 + {hashed_sql('v', 'h', seed=3)} % 8 as w from (select distinct {hashed_sql('id', seed=1)} % 500 as v, id // 5 as h from range(1000) t(id))")(lambda s, d: with_weights(hypergraph(s, 500, 200, 5), 500, 3))
register("weighted_graph", f"select src, dst, 1 + {hashed_sql('src', 'dst', seed=1)} % 8 as w from {_MESH}")(lambda s, d: with_weights(grid(s, 20), 400))
register("double_weighted_graph", f"select src, dst, {uniform_sql('src', 'dst', seed=1)} as w from {_MESH}")(lambda s, d: with_double_weights(grid(s, 20)))
_U1, _U2 = uniform_sql("id", seed=1), uniform_sql("id", seed=2)
register("random_sequences", f"select id as idx, cast(floor({_U1} * 1000) as bigint) as x, 'uniform' as kind from range(1000) t(id) union all select id, cast(floor(pow(1000e0, {_U1})) as bigint), 'exponential' from range(1000) t(id) "
         f"union all select id, cast(case when {_U1} < 0.01e0 then floor({_U2} * 1000) else id end as bigint), 'almost_sorted' from range(1000) t(id)")(
    lambda s, d: random_sequence(s, 1000).withColumn("kind", F.lit("uniform")).unionByName(random_sequence(s, 1000, "exponential").withColumn("kind", F.lit("exponential"))).unionByName(random_sequence(s, 1000, "almost_sorted").withColumn("kind", F.lit("almost_sorted")))
)
register("belief_tree", "select i as id, 0.1 as p0 from range(15) t(i)")(_belief)


def _belief_by_residual(s, d):
    from ..operators.analytics import belief_propagation

    return belief_propagation(*field(s, "tree", 15), by_residual=True).select("id", F.round("p0", 4).alias("p0"))


register("belief_by_residual", "select i as id, 0.1 as p0 from range(15) t(i)")(_belief_by_residual)


def _ising(s, d):
    from ..operators.analytics import belief_propagation

    return belief_propagation(*field(s, "ising", 6, 6, 1.0)).select("id", F.round("p0", 4).alias("p0"))


register("belief_ising")(_ising)
for _kind, _weights in {"flat": [1.0] * 16, "cubic": [(i + 1.0) ** 3 for i in range(16)], "exponential": [2.0**-i for i in range(16)]}.items():
    _below = " ".join(f"when u < cast('{sum(_weights[: i + 1]) / sum(_weights)!r}' as double) then {i}" for i in range(16))
    register(f"priority_workload_{_kind}", f"select id as idx, case {_below} else 15 end as bucket from (select id, {uniform_sql('id', seed=1)} as u from range(1000) t(id))")(lambda s, d, k=_kind: workload(s, 1000, 16, k))
