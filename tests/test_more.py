"""Operators without SQL against plain versions, and the guarantees that hold beyond the small tables."""

import heapq
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomframe import registry, tables
from loomframe.functions import hashing
from loomframe.operators import analytics as A
from loomframe.operators import loops, numeric, ordered, sequence, spatial, text
from loomframe.plans import htap
from loomframe.sources import binary, formats, generators


def test_dense_splits_a_hot_value(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.8 else rng.randrange(20), i) for i in range(5000)]
    got = sequence.dense(spark.createDataFrame(rows, "a long, b long").repartition(6), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.idx)] == sorted(rows) and sorted(r.idx for r in got) == list(range(5000))
    assert sequence.dense(spark.createDataFrame([], "a long"), ["a"]).count() == 0
    # strings order too
    assert [r.s for r in sequence.dense(spark.createDataFrame([("b",), ("a",), ("c",)], "s string"), ["s"]).orderBy("idx").collect()] == ["a", "b", "c"]


def test_kth_smallest_narrows(spark):
    rng = random.Random(2)
    for values in ([rng.randrange(10**6) for _ in range(4000)], [rng.randrange(4) for _ in range(4000)], [5] * 300):
        seq = spark.createDataFrame(list(enumerate(values)), "idx long, x long")
        for k in (0, 17, len(values) // 2, len(values) - 1):
            assert sequence.kth_smallest(seq, k, few=50).first().x == sorted(values)[k]
        assert sequence.kth_smallest(seq, len(values), few=50).first() is None
    m = spark.createDataFrame([(3 * i, i) for i in range(40)], "k long, v long")
    assert ordered.select_rank(m, 11).first().k == 33


def test_seeded_values_are_spread(spark):
    got = [r.h for r in spark.range(20000).select(hashing.hashed(F.col("id"), seed=3).alias("h")).collect()]
    assert len(set(got)) == 20000 and all(0 <= h < 1 << 62 for h in got)
    for bits in (got, [h >> 40 for h in got]):
        counts = Counter(h % 16 for h in bits)
        assert max(abs(c - 1250) for c in counts.values()) < 200
    other = [r.h for r in spark.range(20000).select(hashing.hashed(F.col("id"), seed=4).alias("h")).collect()]
    assert sum(a % 2 == b % 2 for a, b in zip(got, other, strict=True)) < 10400


def test_scratch_is_shared_or_refused(spark, tmp_path):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        tables.scratch(Elsewhere)
    a = tables.stored(spark.range(3))
    at = a._stored.removeprefix("file://")
    import os

    assert os.path.isdir(at)
    tables.forget(a)
    tables.forget(a)
    tables.forget(spark.range(1))
    assert not os.path.isdir(at)


def test_versions_share_files(spark, tmp_path):
    store = htap.open_store(spark, "/root/testdata/sf0.001", keep=2)
    first = store.history[0]["files"]
    store.payments(spark.createDataFrame([(1, 5.0)], "custkey long, amount double"))
    assert store.history[1]["files"]["orders"] == first["orders"] and store.history[1]["files"]["customer"] != first["customer"]
    old = store.read("customer", 0)
    before = {r.c_custkey: r.c_acctbal for r in old.collect()}
    now = {r.c_custkey: r.c_acctbal for r in store.read("customer").collect()}
    assert now[1] == before[1] - 5 and all(now[k] == before[k] for k in before if k != 1)
    store.payments(spark.createDataFrame([(1, 5.0)], "custkey long, amount double"))
    assert store.versions() == [1, 2]
    with pytest.raises(ValueError):
        store.read("customer", 0)
    assert store.read("orders").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_loader_counts_fields(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a|2.5|\n2|b||\n")
    assert [tuple(r) for r in htap.read_delimited(spark, str(tmp_path / "t.tbl"), "k long, s string, v double").orderBy("k").collect()] == [(1, "a", 2.5), (2, "b", None)]
    (tmp_path / "bad.tbl").write_text("1|a|\n")
    with pytest.raises(Exception, match="not 3 fields"):
        htap.read_delimited(spark, str(tmp_path / "bad.tbl"), "k long, s string, v double").collect()


def test_worklists(spark):
    rng = random.Random(4)
    claims = [(i, p) for i in range(60) for p in rng.sample(range(25), rng.randrange(1, 4))]
    left, want, r = set(range(60)), {}, 0
    while left:
        first = {}
        for i, p in claims:
            if i in left:
                first[p] = min(first.get(p, i), i)
        won = {i for i in left if all(first[p] == i for j, p in claims if j == i)}
        want |= dict.fromkeys(won, r)
        left, r = left - won, r + 1
    assert {x.item: x.round for x in loops.speculative_for(spark.createDataFrame(claims, "item long, place long")).collect()} == want
    rows = [(rng.randrange(1000),) for _ in range(9000)]
    total = loops.reducible(spark.createDataFrame(rows, "x long"), F.col("x"), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
    assert total.first().total == max(x for (x,) in rows)


def test_neighbours_of_keys(spark):
    rng = random.Random(21)
    for have in (rng.sample(range(-300, 300), 150), [3**i for i in range(35)], list(range(2000)), []):
        have = sorted(have)
        asked = [*have, *rng.sample(range(-400, 400), 100)]
        got = ordered.next_keys(spark.createDataFrame([(k, 0) for k in have], "k long, v long"), spark.createDataFrame([(k,) for k in asked], "k long"))
        want = [(k, min((h for h in have if h > k), default=None), max((h for h in have if h < k), default=None)) for k in asked]
        assert Counter(map(tuple, got.collect())) == Counter(want)
        # a frame up to the range's end is folded anew for each row
        assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_sums_of_ranges(spark):
    rng = random.Random(22)
    m = {k: rng.randrange(-50, 50) for k in rng.sample(range(-300, 300), 200)}
    asked = [(i, lo, lo + rng.randrange(-20, 60)) for i, lo in enumerate(rng.choices(range(-400, 400), k=150))] + [(1000 + i, 5, 9) for i in range(50)]
    got = ordered.aug_range(spark.createDataFrame(list(m.items()), "k long, v long"), spark.createDataFrame(asked, "id long, lo long, hi long"))
    assert {r.id: r.total for r in got.collect()} == {i: sum(v for k, v in m.items() if lo <= k <= hi) for i, lo, hi in asked}
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert ordered.aug_range(spark.createDataFrame([], "k long, v long"), spark.createDataFrame([(1, 2, 3)], "id long, lo long, hi long")).first().total == 0


def test_long_chains_of_claims(spark):
    rng = random.Random(23)
    claims = [(i, p) for i in range(3000) for p in ({0} if i < 900 else set()) | set(rng.sample(range(700), 2))] + [(5000, None), (5001, None), (5001, 0)]
    want, last = {}, {}
    for i, own in itertools.groupby(claims, lambda c: c[0]):
        own = [p for _, p in own if p is not None]
        want[i] = 1 + max((last.get(p, -1) for p in own), default=-1)
        last |= dict.fromkeys(own, want[i])
    assert want[5001] >= 900  # as many rounds of joins as that would take minutes
    rows = spark.createDataFrame(claims, "item long, place long")
    for together in (1 << 20, 1000, 400):
        assert {x.item: x.round for x in loops.speculative_for(rows, together).collect()} == want


def test_edit_distance(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(12))), "".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for _ in range(60)] + [("", ""), ("x" * 200, "y" * 90)]

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
            row = new
        return row[-1]

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == brute(r.a, r.b) for r in got)


def test_huffman_is_optimal(spark):
    rng = random.Random(6)
    weights = [(chr(97 + i), rng.randrange(1, 500)) for i in range(20)]
    got = {r.symbol: r.length for r in text.huffman(spark.createDataFrame(weights, "symbol string, weight long")).collect()}
    heap, cost = [w for _, w in weights], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    assert sum(w * got[s] for s, w in weights) == cost and sum(2.0 ** -x for x in got.values()) == 1.0


def test_longest_repeat(spark):
    rng = random.Random(7)
    s = "".join(rng.choice("ab") for _ in range(120))
    chars = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(s)], "idx long, c long")
    got = text.lcp(chars, text.suffix_array(chars)).agg(F.max("lcp")).first()[0]
    assert got == max(k for i in range(120) for j in range(i) for k in range(121) if s[i : i + k] == s[j : j + k] and i + k <= 120)


def test_postings_are_counted_in_the_row(spark):
    rows = [(1, "b a b, A!"), (2, None), (3, ""), (4, "1 2"), (5, "é a-a")]
    got = {(r.doc_id, r.word): r.weight for r in text.inverted_index(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (5, "a"): 2}


def test_flow(spark):
    rng = random.Random(8)
    for seed in range(4):
        e = [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 12)) for _ in range(26)]
        left = Counter()
        for a, b, w in e:
            if a != b:
                left[a, b] += w
        flow = 0
        while True:
            came, todo = {0: None}, [0]
            for a in todo:
                for b in range(9):
                    if left[a, b] > 0 and b not in came:
                        came[b] = a
                        todo.append(b)
            if 8 not in came:
                break
            way, b = [], 8
            while came[b] is not None:
                way.append((came[b], b))
                b = came[b]
            room = min(left[x] for x in way)
            for a, b in way:
                left[a, b] -= room
                left[b, a] += room
            flow += room
        df = spark.createDataFrame(e, "src long, dst long, w long")
        assert A.max_flow(df, 0, 8) == flow
        if seed == 0:
            assert A.max_flow(df, 0, 8, together=0) == flow


def test_paths_that_are_long(spark):
    line = spark.createDataFrame([(i, i + 1, 1) for i in range(40)], "src long, dst long, w long")
    assert [(r.step, r.id, r.dist) for r in A.path(A.bfs(line, 0), 40).orderBy("step").collect()] == [(i, i, i) for i in range(41)]
    assert A.path(A.bfs(line, 3), 2).isEmpty() and A.path(A.bfs(line, 3), 3).collect()[0].step == 0
    assert {r.id: r.dist for r in A.shortest_paths(line, 0, delta=4).collect()} == {i: i for i in range(41)}
    cycle = spark.createDataFrame([(i, (i + 1) % 9 if i < 9 else 9 + (i - 8) % 21) for i in range(30)], "i long, p long")
    assert A.cycle_count(cycle).first().cycles == 2


def test_belief_of_a_random_tree_is_exact(spark):
    nodes, edges = generators.field(spark, "random_tree", 7, seed=5)
    n, e = {r.id: (r.l0, r.l1) for r in nodes.collect()}, [tuple(r) for r in edges.collect()]
    weight = Counter()
    for state in itertools.product((0, 1), repeat=7):
        log = sum(n[i][s] for i, s in enumerate(state)) + sum((t00, t01, t10, t11)[2 * state[a] + state[b]] for a, b, t00, t01, t10, t11 in e if a < b)
        for i, s in enumerate(state):
            weight[i, s] += math.exp(log)
    for by_residual in (False, True):
        got = {r.id: r.p0 for r in A.belief_propagation(nodes, edges, by_residual=by_residual).collect()}
        assert all(abs(got[i] - weight[i, 0] / (weight[i, 0] + weight[i, 1])) < 1e-3 for i in range(7))


def test_forces_of_cells_are_near_the_exact_ones(spark):
    rng = random.Random(9)
    rows = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(1, 3)) for i in range(220)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, m double")
    exact = {r.id: (r.fx, r.fy, r.fz) for r in numeric.forces(df, together=50).collect()}
    for i, x, y, z, m in rows[:20]:
        want = [0.0, 0.0, 0.0]
        for j, *p, m2 in rows:
            if j != i:
                d = [p[0] - x, p[1] - y, p[2] - z]
                r = math.sqrt(sum(v * v for v in d))
                want = [w + m * m2 * v / r**3 for w, v in zip(want, d, strict=True)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(exact[i], want, strict=True))
    near = {r.id: (r.fx, r.fy, r.fz) for r in numeric.forces(df, 6.0).collect()}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    errors = sorted(size([a - b for a, b in zip(near[i], exact[i], strict=True)]) / size(exact[i]) for i in exact)
    assert errors[len(errors) // 2] < 0.02 and errors[-1] < 0.3
    plan = numeric.forces(df, 6.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_pairs_of_blocks(spark):
    rng = random.Random(24)
    rows = [(i, *[float(rng.randrange(-3, 4)) for _ in range(3)], rng.uniform(1, 3)) for i in range(200)] + [(5, 9.0, 9.0, 9.0, 1.0), (900, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, m double")
    want = {r[0]: [0.0] * 3 for r in rows}
    for i, *p, m in rows:
        for j, *q, m2 in rows:
            if i != j and None not in p + q and p != q:
                r = math.dist(p, q)
                want[i] = [w + m * m2 * (b - a) / r**3 for w, a, b in zip(want[i], p, q, strict=True)]
    for found in (numeric.forces(df, together=20), numeric.forces(df), numeric._all_pairs(df.dropna(), 20, 3)):
        got = {r.id: (r.fx, r.fy, r.fz) for r in found.collect()}
        assert all(abs(a - b) < 1e-9 for i in got for a, b in zip(got[i], want[i], strict=True)) and len(got) >= 200
    # a pair of blocks is a row, not a pair of bodies
    assert "MapInArrow" in numeric.forces(df)._jdf.queryExecution().toString()


def test_road_files_in_parts(spark, tmp_path):
    import pandas as pd

    rng = random.Random(25)
    v = pd.DataFrame({"id": range(300), "lat": [rng.uniform(-90, 90) for _ in range(300)], "lon": [rng.uniform(-180, 180) for _ in range(300)]})
    e = pd.DataFrame([(a, b, rng.randrange(10**9)) for a, b in sorted({(rng.choice((7, rng.randrange(250))), rng.randrange(300)) for _ in range(2000)})], columns=["src", "dst", "w"])
    whole, at = formats.encode_road(v, e), tmp_path / "road"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        binary.write_road(spark.createDataFrame(v).repartition(5), spark.createDataFrame(e).repartition(3), str(at))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in at.iterdir() if p.name.startswith("part-"))
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts) == whole
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "part-00000000").write_bytes(whole)
    for places, edges in (binary.read_road_parts(spark, str(at)), binary.read_road_parts(spark, str(tmp_path / "one")), formats.read_road(spark, str(tmp_path / "one"))):
        assert sorted(map(tuple, edges.collect())) == list(e.itertuples(index=False, name=None))
        assert sorted(map(tuple, places.collect())) == list(v.itertuples(index=False, name=None))


def test_delaunay_on_grids_and_at_size(spark):
    rng = random.Random(26)
    for m in (3, 5, 40):
        pts = [(i, float(rng.randrange(m)), float(rng.randrange(m))) for i in range(20)]
        want = set()
        for p, q, r in itertools.combinations(pts, 3):
            turn = (q[1] - p[1]) * (r[2] - p[2]) - (q[2] - p[2]) * (r[1] - p[1])
            if turn and not any(turn * numeric.in_circle(*p[1:], *q[1:], *r[1:], *d[1:]) > 0 for d in pts):
                want.add((p[0], q[0], r[0]))
        got = list(map(tuple, numeric.delaunay(spark.createDataFrame(pts, "id long, x double, y double")).collect()))
        assert len(got) == len(set(got)) and set(got) == want
    line = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(9)] + [(9, None, 1.0)], "id long, x double, y double")
    assert numeric.delaunay(line).count() == 0
    # a pass over all triangles for each point would take hours
    many = [(i, rng.uniform(0, 100), rng.uniform(-1000, 10000)) for i in range(20000)]
    got = numeric.delaunay(spark.createDataFrame(many, "id long, x double, y double")).collect()
    edges = Counter(e for t in got for e in itertools.combinations(t, 2))
    assert len(got) == 2 * len(many) - 2 - sum(n == 1 for n in edges.values()) and max(edges.values()) == 2


def test_points_in_rectangles_of_any_height(spark):
    rng = random.Random(27)
    inf = float("inf")
    pts = [(i, float(rng.randrange(30)), rng.choice((float(rng.randrange(1000)), rng.uniform(-5, 2000), inf)), i % 3) for i in range(300)] + [(300, 5.0, None, 1)]
    rects = [(q, x, y, x + rng.randrange(-1, 9), rng.choice((y, y + rng.randrange(-2, 300), inf))) for q, x, y in ((q, float(rng.randrange(30)), float(rng.randrange(-100, 1000))) for q in range(80))] + [(80, 0.0, -inf, 30.0, inf)]
    want = Counter((q, i, w) for q, x1, y1, x2, y2 in rects for i, x, y, w in pts if y is not None and x1 <= x <= x2 and y1 <= y <= y2)
    r, p = spark.createDataFrame(rects, "q long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(pts, "id long, x double, y double, w int")
    for few in (1 << 19, 0):
        assert Counter(map(tuple, spatial.rectangle_points(r, p, 5, few).collect())) == want
    assert spatial.rectangle_points(r, p.where("false"), 5).count() == 0 == spatial.rectangle_points(r.where("false"), p, 5).count()
    # points are not dealt anew, and a cell is bounded in both directions
    plan = spatial.rectangle_points(r, p, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "c#" in plan


def test_rows_of_rectangles_in_runs(spark, tmp_path):
    rng = random.Random(28)
    inf = float("inf")
    pts = [(i, float(rng.randrange(30)), rng.choice((float(rng.randrange(1000)), inf)), rng.choice((None, 1, 2, 3))) for i in range(300)] + [(300, None, 5.0, 1), (301, 5.0, None, 1)]
    places = [(x, y, x + rng.randrange(-1, 9), rng.choice((y, y + rng.randrange(-2, 600), inf))) for x, y in ((float(rng.randrange(30)), float(rng.randrange(-100, 1000))) for _ in range(20))] + [(0.0, -inf, 30.0, inf), (-0.0, -inf, 30.0, inf), (None, 0.0, 9.0, 9.0)]
    rects = [(rng.choice((None, 1 << 40, q // 2)), *rng.choice(places)) for q in range(90)]
    want = Counter((q, w) for q, x1, y1, x2, y2 in rects for _, x, y, w in pts if None not in (x, y, x1) and x1 <= x <= x2 and y1 <= y <= y2)
    r, p = spark.createDataFrame(rects, "q long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(pts, "id long, x double, y double, w int")
    for few, run, task in ((1 << 19, 1 << 16, 1 << 22), (0, 3, 100), (1 << 19, 1, 1 << 22)):
        assert Counter(map(tuple, spatial.rectangle_rows(r, p, 5, few, run, task).collect())) == want
    assert spatial.rectangle_rows(r, p.where("false"), 5).count() == 0 == spatial.rectangle_rows(r.where("false"), p, 5).count()
    # the query's file holds runs, not a q and w for every pair
    spark.range(400).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(20000).selectExpr("double(id % 50 + 1) as l_quantity", "double(id * 7919 % 20000) as l_extendedprice", "int(id % 7 + 1) as l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["rectangle_report"](spark, str(tmp_path))
    assert got.dtypes == [("q", "bigint"), ("w", "int")]
    got.write.parquet(str(tmp_path / "out"))
    each = spatial.rectangle_points(spatial._rects(spark, str(tmp_path)), spatial._points(spark, str(tmp_path)), 5)
    counted = lambda df: Counter({(x.q, x.w): x["count"] for x in df.groupBy("q", "w").count().collect()})
    n = counted(spark.read.parquet(str(tmp_path / "out")))
    assert n == counted(each) and n.total() > 200_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n.total() / 10


def test_separator_on_a_small_gap(spark):
    import numpy as np

    n, rng = 60, random.Random(28)
    pairs = sorted({(i, i + 1) for i in range(n - 1)} | {(i, min(n - 1, i + rng.randrange(2, 5))) for i in range(0, n - 2, 2)})
    w = np.zeros((n, n))
    for a, b in pairs:
        w[a, b] = w[b, a] = 1
    d = w.sum(1)
    second = np.linalg.eigh(w / np.sqrt(d[:, None] * d[None, :]))[1][:, -2] / np.sqrt(d)
    steps = []

    def step(v):
        steps.append(1)
        return 0.5 * v + 0.5 * (w @ v) / d

    x = A._slowest(step, d, np.array([rng.random() - 0.5 for _ in range(n)]), 1e-10, 1 << 20)
    x, second = x / np.abs(x).max(), second / np.abs(second).max()
    assert min(np.abs(x - second).max(), np.abs(x + second).max()) < 1e-5 and len(steps) < 400  # the power iteration takes thousands
    e = spark.createDataFrame([(7 * a, 7 * b) for a, b in pairs], "src long, dst long")
    v = spark.range(n).select((F.col("id") * 7).alias("id"))
    for together in (1 << 22, 100):  # on the driver, and with the edges in tasks
        side = {r.id: r.side for r in A.separator(e, v, error=1e-6, together=together).collect()}
        assert len(side) == n and len({side[7 * i] for i in range(n) if second[i] < np.quantile(second, 0.4)}) == 1 and abs(sum(side.values()) - n / 2) <= 2
    assert A.separator(e.where("false"), v.where("false")).count() == 0


def test_hull_is_convex_and_holds_all(spark):
    rng = random.Random(10)
    pts = [(rng.randrange(20), rng.randrange(20)) for _ in range(70)]
    got = [(r.x, r.y) for r in numeric.convex_hull(spark.createDataFrame(pts, "x long, y long").repartition(3)).orderBy("place").collect()]
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    around = list(zip(got, got[1:] + got[:1], strict=True))
    assert len(set(got)) == len(got) and all(turn(a, b, p) <= 0 for a, b in around for p in pts)
    assert got[0][0] == min(x for x, _ in pts)


def test_lasso_is_optimal(spark):
    rng = random.Random(11)
    rows = [(x := rng.gauss(0, 1), y := rng.gauss(0, 2), z := rng.gauss(0, 1), 3 * x - y + rng.gauss(0, 0.1)) for _ in range(300)]
    w = numeric.lasso(spark.createDataFrame(rows, "a double, b double, c double, t double"), ["a", "b", "c"], "t", 0.5)

    def cost(w):
        mean = [sum(r[j] for r in rows) / len(rows) for j in range(4)]
        sd = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in rows) / (len(rows) - 1)) for j in range(4)]
        loss = sum((r[3] - mean[3] - sum(wj * (r[j] - mean[j]) for j, wj in enumerate(w))) ** 2 for r in rows) / (2 * len(rows))
        return loss + 0.5 * sum(abs(wj) * sd[j] for j, wj in enumerate(w))

    best = cost(w)
    assert all(cost([v + d * (j == i) for j, v in enumerate(w)]) >= best - 1e-4 for i in range(3) for d in (-0.05, 0.05)) and abs(w[2]) < 1e-3


def test_decision_tree_finds_a_rule(spark):
    rng = random.Random(12)
    rows = [(i, a := rng.random(), b := rng.random(), "u" if a < 0.3 else "v" if b < 0.6 else "w") for i in range(400)]
    out = numeric.decision_tree(spark.createDataFrame(rows, "id long, a double, b double, t string"), ["a", "b"], "t").collect()
    assert sum(r.t == r.predicted for r in out) >= 0.97 * len(rows)


def test_nearest_on_sparse_points(spark):
    rng = random.Random(13)
    pts = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(30)] + [(99, 5e4, 5e4)]
    asked = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(10)] + [(50, -9e4, 2e4)]
    got = {(r.q, r.rank): r.id for r in spatial.nearest(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(asked, "q long, x double, y double"), 0.1, 2).collect()}
    for q, x, y in asked:
        by = sorted(pts, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))
        assert [got[q, 1], got[q, 2]] == [by[0][0], by[1][0]]


def test_binary_keeps_all_bits(spark, tmp_path):
    big = (1 << 62) + 12345
    rows = spark.createDataFrame([(0, 0, big), (1, 0, (1 << 53) + 1)], "a long, b long, x long")
    binary.write_sections([(rows, "<u8"), (spark.createDataFrame([(0, 0, 0.1)], "a long, b long, x double"), "<f8")], str(tmp_path / "b"))
    assert [r.x for r in binary.read_section(spark, str(tmp_path / "b"), 0, 2, "<u8").orderBy("idx").collect()] == [big, (1 << 53) + 1]
    assert binary.read_section(spark, str(tmp_path / "b"), 16, 1, "<f8").first().x == 0.1


def test_hypergraph_and_triangle_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 0), (0, 1), (2, 1)], "v long, h long")
    formats.write_hyper_adjacency(m, 3, 2, str(tmp_path / "h"))
    body = "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*"))).split()
    assert body == "AdjacencyHypergraph 3 3 2 3 0 2 2 0 1 1 0 1 0 0 2".split()
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], "idx long, x double, y double")
    formats.write_triangles(pts, spark.createDataFrame([(0, 0, 1, 2)], "idx long, a long, b long, c long"), str(tmp_path / "t"))
    got, tri = formats.read_triangles(spark, str(tmp_path / "t"))
    assert [(r.x, r.y) for r in got.orderBy("idx").collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)] and [(r.a, r.b, r.c) for r in tri.collect()] == [(0, 1, 2)]
