"""Numeric, learning and geometry examples."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import register
from ..tables import stored, table
from .sequence import dense


def primes(spark: SparkSession, n: int) -> DataFrame:
    """(p): primes up to n; multiples of the primes up to the root are taken out."""
    small = [p for p in range(2, int(n**0.5) + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    out = spark.range(2, n + 1).select(F.col("id").alias("p"))
    steps = spark.createDataFrame([(p,) for p in small] or [(n + 1,)], "q long")
    multiples = steps.select(F.explode(F.expr(f"case when 2 * q <= {n} then sequence(2 * q, cast({n} as bigint), q) else array() end")).alias("p")).distinct()
    return out.join(multiples, "p", "left_anti")


def line_fit(points: DataFrame) -> DataFrame:
    """(intercept, slope) of least squares over (x, y)."""
    return points.agg(F.regr_intercept("y", "x").alias("intercept"), F.regr_slope("y", "x").alias("slope"))


def fft(blocks: DataFrame) -> DataFrame:
    """(block, k, re, im) of rows (block, xs), whose length is a power of two."""

    def run(batches):
        for b in batches:
            for block, xs in zip(b["block"], b["xs"], strict=True):
                y = np.fft.fft(np.asarray(xs, float))
                yield pd.DataFrame({"block": block, "k": np.arange(len(y)), "re": y.real, "im": y.imag})

    return blocks.mapInPandas(run, "block long, k long, re double, im double")


@F.pandas_udf(T.StringType())
def big_add(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([str(int(x) + int(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def big_multiply(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([str(int(x) * int(y)) for x, y in zip(a, b, strict=True)])


def k_means(points: DataFrame, k: int, epsilon: float = 1e-4, rounds: int = 1 << 20, seed: int = 1) -> DataFrame:
    """(id, cluster) of points (id, v array<double>): distance-weighted seeding by hash order, then Lloyd rounds until no centre moves by epsilon."""
    spark = points.sparkSession
    pick = lambda r: F.pmod(F.xxhash64(F.lit(seed + r), "id"), F.lit(1 << 30)) / float(1 << 30)
    centres = [points.orderBy(pick(0), "id").first()["v"]]

    def distance(c):
        return F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    for r in range(1, k):
        d = F.least(*[distance(c) for c in centres]) if len(centres) > 1 else distance(centres[0])
        # the least -log(u) / weight is a draw in proportion to the weight
        centres.append(points.where(d > 0).orderBy(-F.log(pick(r) + 1e-12) / d, "id").first()["v"])
    for _ in range(rounds):
        near = F.array_position(ds := F.array(*[distance(c) for c in centres]), F.array_min(ds)) - 1
        told = points.select("id", "v", near.alias("cluster"))
        means = told.select("cluster", F.posexplode("v")).groupBy("cluster", "pos").agg(F.avg("col").alias("m")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).collect()  # k rows
        new = list(centres)
        for m in means:
            new[m.cluster] = [x.m for x in m.c]
        moved = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for x, y in zip(centres, new, strict=True))
        centres = new
        if moved < epsilon:
            break
    return told.select("id", "cluster")


def k_nearest_vectors(queries: DataFrame, points: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(q, id, rank): exact k nearest vectors of each query: queries in blocks against all rows, partial results first."""
    rows = queries.select("q", "v").collect()  # the stated query set
    out = None
    for at in range(0, len(rows), block):
        own = rows[at : at + block]
        m = np.array([r.v for r in own], np.float64)

        def run(batches, m=m, ids=[r.q for r in own]):
            for b in batches:
                x = np.array(b["v"].tolist(), np.float64)
                if not len(x):
                    continue
                d2 = ((m[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
                best = np.argsort(d2, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"q": np.repeat(ids, best.shape[1]), "id": b["id"].to_numpy()[best.ravel()], "d2": np.take_along_axis(d2, best, 1).ravel()})

        part = points.select("id", "v").mapInPandas(run, "q long, id long, d2 double")
        out = part if out is None else out.unionByName(part)
    top = out.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, k).alias("t"))
    return top.select("q", F.posexplode("t").alias("rank", "t")).select("q", "t.id", (F.col("rank") + 1).alias("rank"))


def upper_hull(points: DataFrame) -> DataFrame:
    """(x, y): the upper hull left to right; each task's hull first, then the hull of those."""

    def hull(xy: np.ndarray) -> list:
        out: list = []
        for p in sorted(map(tuple, xy)):
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) >= 0:
                out.pop()
            while out and out[-1][0] == p[0] and out[-1][1] <= p[1]:
                out.pop()
            out.append(p)
        return out

    def run(batches):
        kept: list = []
        for b in batches:
            kept = hull(np.array([*kept, *b[["x", "y"]].to_numpy().tolist()]).reshape(-1, 2))
        if kept:
            yield pd.DataFrame(kept, columns=["x", "y"])

    part = points.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(run, "x double, y double")
    return part.coalesce(1).mapInPandas(run, "x double, y double")


def convex_hull(points: DataFrame) -> DataFrame:
    """(place, x, y): the hull's points clockwise from the leftmost, highest first; each once."""
    own = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    up = upper_hull(own).select(F.lit(0).alias("side"), F.col("x").alias("k"), "x", "y")
    low = upper_hull(own.select((-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).select(F.lit(1).alias("side"), F.col("x").alias("k"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))
    both = up.unionByName(low).groupBy("x", "y").agg(F.min(F.struct("side", "k")).alias("at"))
    return dense(both.select(F.col("at.side").alias("side"), F.col("at.k").alias("k"), "x", "y"), ["side", "k"]).select(F.col("idx").alias("place"), "x", "y")


def kernels(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> dict[str, Column]:
    """cross and dot product of b - a and c - a, and the angle between them."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    cross, dot = ux * vy - uy * vx, ux * vx + uy * vy
    return {"cross": cross, "dot": dot, "angle": F.atan2(cross, dot)}


def cartesian_tree(seq: DataFrame) -> DataFrame:
    """(idx, parent) of (idx, x): the larger of the nearest smaller neighbours; ties are taken by position; the least element is its own parent.

    One sorted stream: a stack of candidates is what one task must hold.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        idx, x = rows["idx"].to_numpy(), rows["x"].to_numpy()
        left, right, stack = {}, {}, []
        for i in range(len(x)):
            while stack and x[stack[-1]] > x[i]:
                right[stack.pop()] = i
            if stack:
                left[i] = stack[-1]
            stack.append(i)
        parent = [i if i not in left and i not in right else left[i] if i not in right or (i in left and x[left[i]] >= x[right[i]]) else right[i] for i in range(len(x))]
        return pd.DataFrame({"idx": idx, "parent": idx[parent]})

    return seq.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(lambda rows: run(rows[["idx", "x"]]), "idx long, parent long")


def range_minimum(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, idx): first position of the least element in [lo, hi] of queries (q, lo, hi): a sparse table by doubling, two look-ups a query."""
    level = stored(seq.select("idx", F.struct("x", "idx").alias("m"), F.lit(0).alias("j")))
    all_levels, n, j = level, seq.count(), 0
    while (1 << (j + 1)) <= n:
        far = level.select((F.col("idx") - (1 << j)).alias("idx"), F.col("m").alias("f"))
        level = stored(level.join(far, "idx").select("idx", F.least("m", "f").alias("m"), F.lit(j + 1).alias("j")))
        all_levels, j = all_levels.unionByName(level), j + 1
    q = queries.withColumn("j", F.floor(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int"))
    ends = q.select("q", "j", F.col("lo").alias("idx")).unionByName(q.select("q", "j", (F.col("hi") + 1 - F.pow(F.lit(2), "j")).cast("long").alias("idx")))
    return ends.join(all_levels, ["idx", "j"]).groupBy("q").agg(F.min("m").alias("m")).select("q", "m.idx")


def decision_tree(rows: DataFrame, features: list[str], label: str, depth: int = 5) -> DataFrame:
    """``rows`` with a prediction of an entropy-split tree (rows of another set may be given to the fitted model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="__f"), StringIndexer(inputCol=label, outputCol="__l"), DecisionTreeClassifier(featuresCol="__f", labelCol="__l", impurity="entropy", maxDepth=depth)]
    model = Pipeline(stages=steps).fit(rows)
    names = model.stages[1].labels
    return model.transform(rows).withColumn("predicted", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))).drop("__f", "__l", "rawPrediction", "probability", "prediction")


def lasso(rows: DataFrame, features: list[str], label: str, weight: float) -> list[float]:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=features, outputCol="__f").transform(rows)
    return list(LinearRegression(featuresCol="__f", labelCol=label, elasticNetParam=1.0, regParam=weight).fit(data).coefficients)


def ray_cast(triangles: DataFrame, rays: DataFrame) -> DataFrame:
    """(ray, tri): the first triangle (tri, ax .. cz) that each ray (ray, ox, oy, oz, dx, dy, dz) hits.

    The rays are the stated query set and go to all tasks; each task keeps its
    nearest hits, which are then reduced by ray.
    """
    r = {x.ray: np.array([[x.ox, x.oy, x.oz], [x.dx, x.dy, x.dz]], float) for x in rays.collect()}

    def run(batches):
        for b in batches:
            p = b[["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]].to_numpy(float).reshape(-1, 3, 3)
            e1, e2 = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
            for ray, (o, d) in r.items():
                h = np.cross(d, e2)
                det = (e1 * h).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = o - p[:, 0]
                    u = (s * h).sum(1) / det
                    q = np.cross(s, e1)
                    v = (q @ d) / det
                    t = (e2 * q).sum(1) / det
                hit = (np.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-9)
                if hit.any():
                    i = np.flatnonzero(hit)[t[hit].argmin()]
                    yield pd.DataFrame({"ray": [ray], "t": [t[i]], "tri": [b["tri"].iloc[i]]})

    return triangles.mapInPandas(run, "ray long, t double, tri long").groupBy("ray").agg(F.min_by("tri", F.struct("t", "tri")).alias("tri"))


def _pull(pairs: DataFrame) -> DataFrame:
    """(id, fx, fy, fz) of bodies (id, x, y, z, m) each with one other mass (x2, y2, z2, m2)."""
    r2 = sum(((F.col(a + "2") - F.col(a)) * (F.col(a + "2") - F.col(a)) for a in "xyz"), F.lit(0.0))
    k = F.when(r2 > 0, F.col("m") * F.col("m2") / (r2 * F.sqrt(r2))).otherwise(0.0)
    return pairs.select("id", *[(k * (F.col(a + "2") - F.col(a))).alias("f" + a) for a in "xyz"])


def _all_pairs(bodies: DataFrame, together: int, at_once: int = 256) -> DataFrame:
    """(id, fx, fy, fz): the sums of all pulls on each body. A block is one row of arrays, so a pair of blocks is one row too; ``at_once`` blocks are broadcast, then the next."""
    blocks = max(1, -(-bodies.count() // together))
    number = ["x", "y", "z", "m"]
    b = bodies.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b1"), F.struct("id", *[F.col(c).cast("double").alias(c) for c in number]).alias("s")).groupBy("b1").agg(F.collect_list("s").alias("s"))
    b = stored(b.select("b1", *[F.col("s")[c].alias(c) for c in ("id", *number)]))
    kind = bodies.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, other = ({c: batch.column(c + n)[i].values for c in ("id", *number)} for n in ("", "2"))
                (*p, m), (*q, m2) = ([side[c].to_numpy(zero_copy_only=False) for c in number] for side in (own, other))
                d = [y[None, :] - x[:, None] for x, y in zip(p, q, strict=True)]
                r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                pulls = r2 > 0
                if batch.column("b1")[i].as_py() == batch.column("b2")[i].as_py():
                    pulls &= own["id"].to_numpy(zero_copy_only=False)[:, None] != other["id"].to_numpy(zero_copy_only=False)[None, :]
                r2[~pulls] = 1.0
                k = np.where(pulls, m[:, None] * m2[None, :] / (r2 * np.sqrt(r2)), 0.0)
                yield pa.RecordBatch.from_arrays([own["id"], *[pa.array((k * x).sum(1)) for x in d]], names=["id", "fx", "fy", "fz"])

    out = None
    for lo in range(0, blocks, at_once):
        hi = min(lo + at_once, blocks)
        right = F.broadcast(b.where(F.col("b1").between(lo, hi - 1)).select(F.col("b1").alias("b2"), *[F.col(c).alias(c + "2") for c in ("id", *number)]))
        pairs = b.repartition(blocks).withColumn("b2", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))).join(right, "b2")
        part = pairs.mapInArrow(run, f"id {kind}, fx double, fy double, fz double").groupBy("id").agg(*[F.sum("f" + a).alias("f" + a) for a in "xyz"])
        part = part if blocks <= at_once else stored(part)  # one broadcast at a time
        out = part if out is None else out.unionByName(part)
        if blocks > at_once and lo // at_once % 16 == 15:
            out = stored(out.groupBy("id").agg(*[F.sum("f" + a).alias("f" + a) for a in "xyz"]))
    return out.groupBy("id").agg(*[F.sum("f" + a).alias("f" + a) for a in "xyz"])


def _offsets(lo: int, hi: int) -> Column:
    """Rows (dx, dy, dz) of a cube of offsets."""
    n = hi - lo + 1
    return F.explode(F.expr(f"transform(sequence(0, {n**3 - 1}), i -> struct(cast(i % {n} + {lo} as long) as x, cast(i div {n} % {n} + {lo} as long) as y, cast(i div {n * n} + {lo} as long) as z))")).alias("s")


def forces(bodies: DataFrame, cell: float | None = None, together: int = 1024) -> DataFrame:
    """(id, fx, fy, fz) on bodies (id, x, y, z, m), G = 1.

    Without ``cell`` the forces are exact: all pairs, array by array, in blocks of about ``together`` bodies.
    With it they come from the bodies of the own and the neighbouring grid cells of that width and, for all others,
    from mass centres of cells that get twice as wide from level to level: at each
    level those that are no neighbours while their parents are, so a body meets at most 189 a level.
    """
    other = lambda b: [F.col("m").alias("m2"), *[F.col(a).alias(a + "2") for a in "xyz"]]
    if cell is None:
        return bodies.select("id").join(_all_pairs(bodies.dropna(subset=["x", "y", "z", "m"]), together), "id", "left").select("id", *[F.coalesce("f" + a, F.lit(0.0)).alias("f" + a) for a in "xyz"])
    b = stored(bodies.select("*", *[F.floor(F.col(a) / cell).alias("c" + a) for a in "xyz"]))
    step = _offsets(-1, 1)
    near = b.select("*", step).select("*", *[(F.col("c" + a) + F.col("s." + a)).alias("d" + a) for a in "xyz"])
    others = b.select(*[F.col("c" + a).alias("d" + a) for a in "xyz"], F.col("id").alias("id2"), *other(b))
    pulls = _pull(near.join(others, ["dx", "dy", "dz"]).where("id <> id2"))
    ends = b.agg(*[f("c" + a).alias(n + a) for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    level = 0
    while ends["lox"] is not None:
        at = b.select("*", *[F.shiftright("c" + a, level).alias("l" + a) for a in "xyz"])
        cells = stored(at.groupBy("lx", "ly", "lz").agg(F.sum("m").alias("m2"), *[(F.sum(F.col(a) * F.col("m")) / F.sum("m")).alias(a + "2") for a in "xyz"]))
        # the children of the parent's neighbours, but for the own neighbours
        asked = cells.select("lx", "ly", "lz", _offsets(-2, 3)).select("lx", "ly", "lz", *[(F.shiftleft(F.shiftright("l" + a, 1), 1) + F.col("s." + a)).alias("d" + a) for a in "xyz"])
        asked = asked.where("greatest(abs(dx - lx), abs(dy - ly), abs(dz - lz)) > 1").join(cells.toDF("dx", "dy", "dz", "m2", "x2", "y2", "z2"), ["dx", "dy", "dz"])
        pulls = pulls.unionByName(_pull(at.join(asked.drop("dx", "dy", "dz"), ["lx", "ly", "lz"])))
        if all((ends["hi" + a] >> level + 1) - (ends["lo" + a] >> level + 1) <= 1 for a in "xyz"):
            break
        level += 1
    return bodies.select("id").join(pulls.groupBy("id").agg(*[F.sum("f" + a).alias("f" + a) for a in "xyz"]), "id", "left").select("id", *[F.coalesce("f" + a, F.lit(0.0)).alias("f" + a) for a in "xyz"])


def in_circle(ax, ay, bx, by, cx, cy, dx, dy):
    """> 0 if d is inside the circle through a, b, c (counter-clockwise)."""
    a, b, c = ((ax - dx), (ay - dy)), ((bx - dx), (by - dy)), ((cx - dx), (cy - dy))
    sq = lambda p: p[0] * p[0] + p[1] * p[1]
    return sq(a) * (b[0] * c[1] - c[0] * b[1]) - sq(b) * (a[0] * c[1] - c[0] * a[1]) + sq(c) * (a[0] * b[1] - b[0] * a[1])


class _Mesh:
    """A Delaunay mesh of distinct points: ``third`` has the third corner of the triangle left of each directed edge, -1 outside the hull.

    Signs are exact: floating point where its error bound allows, else whole numbers.
    """

    def __init__(self, xs: list[float], ys: list[float]):
        self.xs, self.ys, self.third = xs, ys, {}
        scale = max((Fraction(v).denominator for v in (*xs, *ys)), default=1)
        self.whole = [(int(Fraction(x) * scale), int(Fraction(y) * scale)) for x, y in zip(xs, ys, strict=True)]

    def turn(self, a: int, b: int, c: int) -> float:
        xs, ys = self.xs, self.ys
        left, right = (xs[b] - xs[a]) * (ys[c] - ys[a]), (ys[b] - ys[a]) * (xs[c] - xs[a])
        if abs(left - right) > 4e-16 * (abs(left) + abs(right)):
            return left - right
        (ax, ay), (bx, by), (cx, cy) = self.whole[a], self.whole[b], self.whole[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def inside(self, a: int, b: int, c: int, d: int) -> float:
        xs, ys = self.xs, self.ys
        dx, dy = xs[d], ys[d]
        ax, ay, bx, by, cx, cy = xs[a] - dx, ys[a] - dy, xs[b] - dx, ys[b] - dy, xs[c] - dx, ys[c] - dy
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, cb, ac, ca, ab, ba = bx * cy, cx * by, ax * cy, cx * ay, ax * by, bx * ay
        found = a2 * (bc - cb) - b2 * (ac - ca) + c2 * (ab - ba)
        if abs(found) > 2e-15 * (a2 * (abs(bc) + abs(cb)) + b2 * (abs(ac) + abs(ca)) + c2 * (abs(ab) + abs(ba))):
            return found
        return in_circle(*self.whole[a], *self.whole[b], *self.whole[c], *self.whole[d])

    def conflicts(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether ``p`` takes the triangle away; that beyond a hull edge is the half plane and the edge without its ends."""
        while c >= 0 and min(a, b) < 0:
            a, b, c = b, c, a
        if c >= 0:
            return self.inside(a, b, c, p) > 0
        side = self.turn(a, b, p)
        (ax, ay), (bx, by), (px, py) = self.whole[a], self.whole[b], self.whole[p]
        return side > 0 or (side == 0 and (px - ax) * (px - bx) + (py - ay) * (py - by) < 0)

    def add(self, a: int, b: int, c: int) -> None:
        self.third[a, b], self.third[b, c], self.third[c, a] = c, a, b

    def insert(self, p: int, at: tuple[int, int, int]) -> tuple[int, int, int]:
        """Walks from the triangle ``at`` to ``p`` and puts the fan around ``p`` in place of what it takes away; a finite triangle of it."""
        a, b, c = at
        while c >= 0:
            for u, v in ((a, b), (b, c), (c, a)):
                if self.turn(u, v, p) < 0:
                    a, b, c = v, u, self.third[v, u]
                    break
            else:
                break
        third, todo, rim = self.third, [(a, b), (b, c), (c, a)], []
        for e in todo:
            del third[e]
        while todo:
            u, v = todo.pop()
            w = third.get((v, u))
            if w is None:  # taken away as well
                continue
            if self.conflicts(v, u, w, p):
                for e in ((v, u), (u, w), (w, v)):
                    del third[e]
                todo += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            self.add(u, v, p)
        return next((u, v, p) for u, v in rim if min(u, v) >= 0)


def _hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """Places on a curve that visits near points one after another."""
    x, y = (((v - v.min()) / (np.ptp(v) or 1.0) * ((1 << bits) - 1)).astype(np.int64) for v in (x, y))
    out = np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        rx, ry = x >> k & 1, y >> k & 1
        out = out << 2 | (3 * rx ^ ry)
        low = (1 << k) - 1
        x, y = x & low, y & low
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, low - x, x), np.where(flip, low - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
    return out


def _empty_circles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Places of all points on each circle through three or more distinct points that holds no other."""
    n = len(x)
    order = np.random.default_rng(1).permutation(n)
    ends = [0, *itertools.takewhile(lambda k: k < n, (64 << k for k in range(64))), n]
    order = np.concatenate([own[np.argsort(_hilbert(x[own], y[own]), kind="stable")] for i, j in itertools.pairwise(ends) if len(own := order[i:j])] or [order]).tolist()
    mesh = _Mesh(x.tolist(), y.tolist())
    k = next((k for k in range(2, n) if mesh.turn(order[0], order[1], order[k])), None)
    if k is None:
        return
    a, b, c = order[0], order[1], order.pop(k)
    a, b = (a, b) if mesh.turn(a, b, c) > 0 else (b, a)
    for t in ((a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)):
        mesh.add(*t)
    at = (a, b, c)
    for p in order[2:]:
        at = mesh.insert(p, at)
    # triangles side by side on one circle belong together
    seen: set = set()
    for (u, v), w in mesh.third.items():
        if min(u, v, w) < 0 or (u, v) in seen:
            continue
        on, todo = {u, v, w}, [(u, v), (v, w), (w, u)]
        seen.update(todo)
        while todo:
            e = todo.pop()
            back = e[1], e[0]
            far = mesh.third[back]
            if back not in seen and far >= 0 and mesh.inside(u, v, w, far) == 0:
                on.add(far)
                edges = [back, (back[1], far), (far, back[0])]
                seen.update(edges)
                todo += edges[1:]
        yield tuple(on)


def delaunay(points: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: all triples of points (id, x, y) whose circle holds no other point, by incremental insertion, in one task: the mesh is one object.

    Four and more points on one empty circle give all of their triples, and points of one place each their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat([pd.DataFrame({"id": np.empty(0, "int64"), "x": np.empty(0), "y": np.empty(0)}), *batches]).dropna()
        spots = [(x, y, g.tolist()) for (x, y), g in p.groupby(["x", "y"])["id"]]
        out = []
        for on in _empty_circles(np.array([q[0] for q in spots], float), np.array([q[1] for q in spots], float)):
            for three in itertools.combinations(on, 3):
                out += [sorted(t) for t in itertools.product(*[spots[v][2] for v in three])]
            if len(out) >= 1 << 16:
                yield pd.DataFrame(out, columns=["a", "b", "c"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "c"], dtype="int64")

    return points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).repartition(1).mapInPandas(run, "a long, b long, c long")


def _parts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _bodies(s, d):
    p = table(s, d, "supplier")
    return p.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 11).cast("double").alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"), (F.col("s_suppkey") / 13.0).alias("z"), (1.0 + F.col("s_nationkey")).alias("m"))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


register("primes", "select i as p from range(2, 5001) t(i) where not exists (select 1 from range(2, 71) u(j) where j < i and i % j = 0)")(lambda s, d: primes(s, 5000))
register("line_fit", "select round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem")(
    lambda s, d: line_fit(table(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))).select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))
)
register("big_add", "select o_orderkey as k, cast(o_orderkey * 1000000007 + o_custkey as varchar) as v from orders")(lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), big_add((F.col("o_orderkey") * 1000000007).cast("string"), F.col("o_custkey").cast("string")).alias("v")))
register("big_multiply", "select o_orderkey as k, cast(cast(o_orderkey * 1000000007 as hugeint) * (o_custkey * 998244353) as varchar) as v from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), big_multiply((F.col("o_orderkey") * 1000000007).cast("string"), (F.col("o_custkey") * 998244353).cast("string")).alias("v"))
)
_X = "(select vec_id as block, len(embedding) as n, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as j from embeddings)"
register("fft", f"select block, k, round(sum(x * cos(2 * pi() * ((j * k) % n) / n)), 5) + 0 as re, round(-sum(x * sin(2 * pi() * ((j * k) % n) / n)), 5) + 0 as im from {_X}, lateral (select unnest(range(n)) as k) group by block, k")(lambda s, d: fft(table(s, d, "embeddings").select(F.col("vec_id").alias("block"), F.col("embedding").cast("array<double>").alias("xs"))).select("block", "k", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im")))
register("k_means")(lambda s, d: k_means(_vectors(s, d), 4))
register("vector_knn", "select q, id, rank from (select q.vec_id as q, p.vec_id as id, row_number() over (partition by q.vec_id order by list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), p.vec_id) as rank from embeddings q, embeddings p where q.vec_id % 100 = 0) where rank <= 10")(lambda s, d: k_nearest_vectors(_vectors(s, d).where("id % 100 = 0").toDF("q", "v"), _vectors(s, d), 10))
def _hull_sql(sign: str) -> str:
    """Points of the upper (``sign`` '') or lower ('-') hull: none of two others on both sides of it make it superfluous."""
    p = f"(select cast(p_size as double) as x, {sign}max({sign}p_retailprice) as y from part group by 1)"
    cmp = ">=" if not sign else "<="
    return f"select x, y from {p} a where not exists (select 1 from {p} l, {p} r where l.x < a.x and r.x > a.x and l.y + (r.y - l.y) * (a.x - l.x) / (r.x - l.x) {cmp} a.y)"


register("convex_hull", f"select distinct x, y from ({_hull_sql('')} union all {_hull_sql('-')})")(lambda s, d: convex_hull(_parts(s, d)).select("x", "y"))
register("upper_hull", "select x, y from (select p_size as x, max(p_retailprice) as y from part group by 1) a where not exists (select 1 from (select p_size as x, max(p_retailprice) as y from part group by 1) l, (select p_size as x, max(p_retailprice) as y from part group by 1) r where l.x < a.x and r.x > a.x and l.y + (r.y - l.y) * (a.x - l.x) / (r.x - l.x) >= a.y)")(lambda s, d: upper_hull(_parts(s, d)).select(F.col("x").cast("int").alias("x"), "y"))
_CT = "(select p_partkey as i, p_retailprice as x from part)"
register("cartesian_tree", f"select i as idx, case when l is null and r is null then i when r is null or (l is not null and lx >= rx) then l else r end as parent from (select i, l, r, (select x from {_CT} where i = l) as lx, (select x from {_CT} where i = r) as rx from (select a.i, (select max(b.i) from {_CT} b where b.i < a.i and b.x <= a.x) as l, (select min(b.i) from {_CT} b where b.i > a.i and b.x < a.x) as r from {_CT} a))")(lambda s, d: cartesian_tree(_parts(s, d).select(F.col("id").alias("idx"), F.col("y").alias("x"))))
register("range_minimum", "select q.p_partkey as q, arg_min(p.p_partkey, p.p_retailprice * 1000000 + p.p_partkey) as idx from part q join part p on p.p_partkey between q.p_partkey and least(q.p_partkey + 37, (select max(p_partkey) from part)) group by 1")(
    lambda s, d: range_minimum(_parts(s, d).select(F.col("id").alias("idx"), F.col("y").alias("x")), _parts(s, d).crossJoin(F.broadcast(_parts(s, d).agg(F.max("id").alias("top")))).select(F.col("id").alias("q"), F.col("id").alias("lo"), F.least(F.col("id") + 37, F.col("top")).alias("hi")))
)
register("decision_tree")(lambda s, d: decision_tree(table(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 256).alias("c"), "o_orderstatus"), ["o_totalprice", "c"], "o_orderstatus").select("o_orderkey", "predicted"))
register("lasso")(lambda s, d: s.createDataFrame([(i, float(x)) for i, x in enumerate(lasso(table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 10.0))], "feature long, weight double"))
_B = "(select s_suppkey as id, cast(s_suppkey % 11 as double) as x, cast(s_suppkey % 7 as double) as y, s_suppkey / 13.0e0 as z, 1.0e0 + s_nationkey as m from supplier)"
_R2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
_PULL = ", ".join(f"round(coalesce(sum(a.m * b.m / ({_R2} * sqrt({_R2})) * (b.{c} - a.{c})), 0), 5) as f{c}" for c in "xyz")
register("n_body", f"select a.id, {_PULL} from {_B} a left join {_B} b on a.id <> b.id and {_R2} > 0 group by a.id")(lambda s, d: forces(_bodies(s, d)).select("id", *[F.round("f" + c, 5).alias("f" + c) for c in "xyz"]))
register("n_body_cells")(lambda s, d: forces(_bodies(s, d), 3.0))
_DP = "(select s_suppkey as id, cast(s_suppkey * 37 % 101 as double) as x, s_acctbal as y from supplier)"
_IN = "((a.x - d.x) * (a.x - d.x) + (a.y - d.y) * (a.y - d.y)) * ((b.x - d.x) * (c.y - d.y) - (c.x - d.x) * (b.y - d.y)) - ((b.x - d.x) * (b.x - d.x) + (b.y - d.y) * (b.y - d.y)) * ((a.x - d.x) * (c.y - d.y) - (c.x - d.x) * (a.y - d.y)) + ((c.x - d.x) * (c.x - d.x) + (c.y - d.y) * (c.y - d.y)) * ((a.x - d.x) * (b.y - d.y) - (b.x - d.x) * (a.y - d.y))"
_TURN = "((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))"
#: All triples of points whose circle holds no other point.
register("delaunay", f"with p as materialized {_DP} select a.id as a, b.id as b, c.id as c from p a join p b on a.id < b.id join p c on b.id < c.id where {_TURN} <> 0 and not exists (select 1 from p d where d.id not in (a.id, b.id, c.id) and sign({_TURN}) * ({_IN}) > 0)")(lambda s, d: delaunay(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), F.col("s_acctbal").alias("y"))))
register("ray_cast", "select n_nationkey as ray, arg_min(p_partkey, {'t': p_retailprice, 'i': p_partkey}) as tri from nation, part where n_nationkey / 10.0e0 / 10 + 1.0e0 / 10 <= 1 and p_retailprice > 1e-9 group by 1")(
    lambda s, d: ray_cast(
        table(s, d, "part").select(F.col("p_partkey").alias("tri"), *[F.lit(v).alias(n) for n, v in (("ax", 0.0), ("ay", 0.0))], F.col("p_retailprice").alias("az"), F.lit(10.0).alias("bx"), F.lit(0.0).alias("by"), F.col("p_retailprice").alias("bz"), F.lit(0.0).alias("cx"), F.lit(10.0).alias("cy"), F.col("p_retailprice").alias("cz")),
        table(s, d, "nation").select(F.col("n_nationkey").alias("ray"), (F.col("n_nationkey") / 10.0).alias("ox"), F.lit(1.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz")),
    )
)
_C = "(l_quantity * 3 - l_quantity) * (l_extendedprice / 7 - l_extendedprice) - (l_extendedprice / 3 - l_extendedprice) * (l_quantity * 7 - l_quantity)"
_D = "(l_quantity * 3 - l_quantity) * (l_quantity * 7 - l_quantity) + (l_extendedprice / 3 - l_extendedprice) * (l_extendedprice / 7 - l_extendedprice)"
register("geometry_kernels", f"select l_orderkey, l_linenumber, round({_C}, 2) as cross, round({_D}, 2) as dot, round(atan2({_C}, {_D}), 8) as angle from lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 8 if n == "angle" else 2).alias(n) for n, c in kernels(*[(F.col("l_quantity") * k, F.col("l_extendedprice") / k) for k in (1.0, 3.0, 7.0)]).items()])
)
