"""Graph analytics against plain versions on small random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import analytics as A
from loomframe.operators import graph
from loomframe.sources import formats, generators


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 10)) for _ in range(110)]
    return rows, spark.createDataFrame(rows, "src long, dst long, w long").cache(), spark.range(45).cache()


def near(rows):
    adj = {v: set() for v in range(45)}
    for a, b, _ in rows:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def test_independent_set_is_lexicographically_first(small):
    rows, e, v = small
    adj, want = near(rows), set()
    for x in range(45):
        if not adj[x] & want:
            want.add(x)
    got = A.independent_set(e, v)
    assert {r.id for r in got.collect()} == want
    assert A.independent_set_errors(e, v, got).isEmpty()


def test_kcore(small):
    rows, e, v = small
    adj, core, k = near(rows), {}, 0
    while adj:
        x = min(adj, key=lambda a: (len(adj[a]), a))
        k = max(k, len(adj[x]))
        core[x] = k
        for y in adj.pop(x):
            adj[y].discard(x)
    assert {r.id: r.core for r in A.kcore(e, v).collect()} == core


def test_matching_and_forest(spark, small):
    rows, e, _ = small
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "eid long, src long, dst long, w long")
    used, want = set(), set()
    for i, a, b, _ in numbered:
        if a != b and a not in used and b not in used:
            used |= {a, b}
            want.add(i)
    assert {r.eid for r in A.matching(df).collect()} == want
    root = list(range(45))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    forest = set()
    for i, a, b, _ in sorted(numbered, key=lambda r: (r[3], r[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            forest.add(i)
    assert {r.eid for r in A.spanning_forest(df).collect()} == forest


def test_colouring_is_proper(small):
    rows, e, v = small
    c = {r.id: r.colour for r in A.colouring(e, v).collect()}
    assert len(c) == 45 and all(c[a] != c[b] for a, b, _ in rows if a != b)


def test_flow_paths_and_negative_cycle(spark):
    e = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4), (3, 4, 5)], "src long, dst long, w long")
    assert A.max_flow(e, 0, 4) == 5
    found = A.shortest_paths(e, 0, delta=2, target=4)
    assert [r.id for r in A.path(found, 4).orderBy("step").collect()] in ([0, 1, 3, 4], [0, 2, 3, 4])
    assert A.bellman_ford(spark.createDataFrame([(0, 1, 1), (1, 0, -2)], "src long, dst long, w long"), 0, 2) is None
    assert {(r.id, r.dist) for r in A.bellman_ford(spark.createDataFrame([(0, 1, 4), (0, 2, 1), (2, 1, -3)], "src long, dst long, w long"), 0, 3).collect()} == {(0, 0), (1, -2), (2, 1)}


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert {r.id: r.score for r in A.betweenness(e, 0).collect()} == {0: 0.0, 1: 2.0, 2: 1.0, 3: 0.0}


def test_a_star(spark):
    places = spark.createDataFrame([(i, 0.0, i * 1e-3) for i in range(5)], "id long, lat double, lon double")
    step = int(A.EARTH_CM * 1e-3) + 2
    e = spark.createDataFrame([(i, i + 1, step) for i in range(4)] + [(0, 4, 10 * step)], "src long, dst long, w long")
    assert [r.id for r in A.a_star(e, places, 0, 4).orderBy("step").collect()] == [0, 1, 2, 3, 4]


def test_belief_on_a_tree(spark):
    out = A.belief_propagation(*generators.field(spark, "tree", 10)).collect()
    assert all(abs(r.p0 - 0.1) < 1e-3 for r in out)


def test_cover_and_decomposition(spark, small):
    rows, e, v = small
    m = e.select(F.col("src").alias("set"), F.col("dst").alias("x"))
    assert A.uncovered(m, A.set_cover(m)).isEmpty()
    got = {r.id: r.centre for r in A.low_diameter(e, v).collect()}
    assert set(got) == set(range(45))
    comp = {r.id: r.component for r in A.components(e, v).collect()}
    assert all(comp[a] == comp[b] for a, b in got.items())


def test_file_formats(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("# comment\n0 1\n\n0   2\n\t1 2\n")
    rows = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert rows(formats.read_edge_list(spark, str(p))) == [(0, 1), (0, 2), (1, 2)]
    (tmp_path / "g.adj").write_text("WeightedAdjacencyGraph\n3\n3\n0\n2\n3\n1\n2\n2\n5\n6\n7\n")
    assert sorted((r.src, r.dst, r.w) for r in formats.read_adjacency(spark, str(tmp_path / "g.adj")).collect()) == [(0, 1, 5.0), (0, 2, 6.0), (1, 2, 7.0)]
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0), (1, 2, 7.0)], "src long, dst long, w double")
    for version in (1, 2):
        formats.write_gr(e, str(tmp_path / f"g{version}.gr"), 3, version)
        assert rows(formats.read_gr(spark, str(tmp_path / f"g{version}.gr"))) == [(0, 1), (0, 2), (1, 2)]
    formats.write_adjacency(e, spark.range(3), str(tmp_path / "adj"))
    text = "".join(x.read_text() for x in sorted((tmp_path / "adj").glob("part-*")))
    assert text.split()[:6] == ["WeightedAdjacencyGraph", "3", "3", "0", "2", "3"]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 3 2\n1 2 0.5\n3 1 2\n")
    assert rows(formats.read_matrix_market(spark, str(tmp_path / "m.mtx"))) == [(0, 1), (2, 0)]
    (tmp_path / "s.txt").write_text("1 3:0.5 7:2\n0 1:1\n")
    assert sorted((r.row, r.feature) for r in formats.read_svmlight(spark, str(tmp_path / "s.txt")).collect()) == [(0, 3), (0, 7), (1, 1)]
    (tmp_path / "c.txt").write_text("1 2 3\n4 5\n")
    assert formats.clique_expansion(formats.read_communities(spark, str(tmp_path / "c.txt"))).count() == 8
    formats.write_metis(graph.symmetrise(e), str(tmp_path / "metis"), 3)
    (tmp_path / "one.metis").write_text("".join(x.read_text() for x in sorted((tmp_path / "metis").glob("part-*"))))
    assert rows(formats.read_metis(spark, str(tmp_path / "one.metis"))) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_files_in_many_splits(spark, tmp_path):
    rng = random.Random(9)
    edges = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(2000)})
    begins = [sum(a < v for a, _ in edges) for v in range(300)]
    words = ["AdjacencyGraph", 300, len(edges), *begins, *[b for _, b in edges]]
    (tmp_path / "g").mkdir()
    for i in range(3):  # parts of several splits each, the first with several words a line
        part = [str(w) for w in words[i * 900 : (i + 1) * 900 if i < 2 else None]]
        (tmp_path / "g" / f"part-{i}").write_text((" " if i == 0 else "\n").join(part[:5]) + "\n\n" + "\n".join(part[5:]) + "\n")
    hyper = ["AdjacencyHypergraph", 3, 4, 2, 4, 0, 2, 3, 0, 1, 1, 0, 0, 2, 0, 2, 0, 1]
    (tmp_path / "h").write_text("\n".join(map(str, hyper)))
    (tmp_path / "s").write_text("sequenceInt\n" + "".join(f"{i * i}\n" for i in range(500)))
    (tmp_path / "t").write_text("triangles\n3\n1\n0 0\n1 0\n0 1\n1 2 3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "g")).rdd.getNumPartitions() > 6
        assert sorted((r.src, r.dst) for r in formats.read_adjacency(spark, str(tmp_path / "g")).collect()) == edges
        assert sorted((r.v, r.h) for r in formats.read_hyper_adjacency(spark, str(tmp_path / "h")).collect()) == [(0, 0), (0, 1), (1, 1), (2, 0)]
        assert sorted((r.idx, r.x) for r in formats.read_sequence(spark, str(tmp_path / "s"), "long").collect()) == [(i, i * i) for i in range(500)]
        points, triangles = formats.read_triangles(spark, str(tmp_path / "t"))
        assert [(r.x, r.y) for r in points.orderBy("idx").collect()] == [(0, 0), (1, 0), (0, 1)]
        assert [(r.a, r.b, r.c) for r in triangles.collect()] == [(0, 1, 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_suffix_array_and_repeat(spark):
    from loomframe.operators import text

    s = "mississippi"
    chars = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(s)], "idx long, c long")
    ranks = text.suffix_array(chars)
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert [r.idx for r in ranks.orderBy("rank").collect()] == want
    assert text.lcp(chars, ranks).agg(F.max("lcp")).first()[0] == 4


def test_upper_hull(spark):
    from loomframe.operators import numeric

    rng = random.Random(3)
    pts = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    df = spark.createDataFrame(pts, "x long, y long").repartition(4)
    got = [(r.x, r.y) for r in numeric.upper_hull(df).orderBy("x").collect()]
    assert all(all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) <= 0 for p in pts) for a, b in itertools.pairwise(got))


def test_stream_matches_batch(spark, tmp_path):
    from loomframe.streaming import windows

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = windows.read_stream(spark, "/root/testdata/sf0.001/events.parquet*")
    q = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, windows.tumbling(batch).collect()))


def test_iterations_converge(spark):
    from loomframe import registry
    from loomframe.operators import numeric
    from loomframe.operators.graph import order_graph

    sf = "/root/testdata/sf0.001"
    value = {r.id: r.value for r in registry.queries()["residual_pagerank"](spark, sf).collect()}
    edges = [(r.src, r.dst) for r in order_graph(spark, sf).collect()]
    left = dict.fromkeys(value, 0.15)
    out = {v: sum(a == v for a, _ in edges) for v in {a for a, _ in edges}}
    for a, b in edges:
        left[b] += 0.85 * value[a] / out[a]
    assert max(left[v] - value[v] for v in value) <= 1e-3 + 1e-9
    points = {r.id: r.v for r in numeric._vectors(spark, sf).collect()}
    cluster = {r.id: r.cluster for r in registry.queries()["k_means"](spark, sf).collect()}
    groups = {c: [points[i] for i in cluster if cluster[i] == c] for c in set(cluster.values())}
    centres = {c: [sum(x) / len(g) for x in zip(*g, strict=True)] for c, g in groups.items()}
    far = lambda i, c: sum((a - b) ** 2 for a, b in zip(points[i], centres[c], strict=True))
    assert all(far(i, cluster[i]) <= min(far(i, c) for c in centres) + 1e-3 for i in points)


def test_separator_halves(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    side = {r.id: r.side for r in A.separator(line, spark.range(40)).collect()}
    assert len({side[i] for i in range(19)}) == len({side[i] for i in range(21, 40)}) == 1 and side[0] != side[39]
    two = spark.createDataFrame([(i + o, j + o) for o in (0, 4) for i in range(4) for j in range(i)] + [(0, 4)], "src long, dst long")
    for together in (0, 100):
        side = {r.id: r.side for r in A.separator(two, spark.range(8), error=1e-2, together=together).collect()}
        assert len({side[i] for i in range(4)}) == len({side[i] for i in range(4, 8)}) == 1 and side[0] != side[4]
