"""Sources and sinks for graph, sequence and geometry files.

Line formats are read as distributed text. Where meaning hangs on a line's
place, lines are numbered over all parts by split: each split counts its own,
and the splits' totals are summed up. Sinks write sorted part files whose
concatenation is the file. Binary graphs and road files in one piece are
decoded with NumPy, a file being one task's work; ``binary`` has formats in
parts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..tables import scratch, stored, table

EDGES = "src long, dst long, w double"


def _fields(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(f): white-space fields of lines that are neither blank nor comments."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    return lines.where((F.col("line") != "") & ~F.startswith("line", F.lit(comment))).select(F.split("line", " ").alias("f"))


def numbered(spark: SparkSession, path: str, keep: Callable[[Column], Column] | None = None, words: bool = False, hint_rows: int = 100_000) -> DataFrame:
    """(idx, line) of all lines of a text in parts, or of those that ``keep`` accepts, or of these lines' words, counted from 0 in the order of the parts' names.

    Ids grow by one inside a split, so a line's place is its id, less the
    split's first, plus the lines of the splits before. The table of splits is
    a row each and is broadcast up to ``hint_rows`` of them.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(keep(F.col("line"))) if keep else lines
    lines = lines.withColumn("line", F.explode(F.split(F.trim("line"), r"\s+"))) if words else lines
    lines = stored(lines.withColumn("id", F.monotonically_increasing_id()))  # written once, so that counts and numbers are of one pass
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).orderBy("file", "block").collect()
    before, rows = 0, []
    for r in splits:
        rows.append((r.file, r.block, before - r.first))
        before += r.n
    shift = spark.createDataFrame(rows, "file string, block long, shift long")
    return lines.join(F.broadcast(shift) if len(rows) <= hint_rows else shift, ["file", "block"]).select((F.col("id") + F.col("shift")).alias("idx"), "line")


def _written(line: Column) -> Column:
    return F.trim(line) != ""


def _n(i: int) -> Column:
    return F.get("f", F.lit(i)).cast("long")


def read_edge_list(spark: SparkSession, path: str, comment: str = "#", base: int = 0) -> DataFrame:
    """src dst [weight] lines, also of SNAP; ids count from ``base``; a missing weight is null."""
    return _fields(spark, path, comment).select((_n(0) - base).alias("src"), (_n(1) - base).alias("dst"), F.get("f", F.lit(2)).cast("double").alias("w"))


def read_csv_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=EDGES)


def read_edge_array(spark: SparkSession, path: str) -> DataFrame:
    """EdgeArray and WeightedEdgeArray files: a header line, then pairs or triples."""
    return _fields(spark, path).where(~F.contains(F.get("f", F.lit(0)), F.lit("EdgeArray"))).select(_n(0).alias("src"), _n(1).alias("dst"), F.get("f", F.lit(2)).cast("double").alias("w"))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """``a src dst weight`` lines, ids from 1."""
    return _fields(spark, path, "c").where(F.get("f", F.lit(0)) == "a").select((_n(1) - 1).alias("src"), (_n(2) - 1).alias("dst"), F.get("f", F.lit(3)).cast("double").alias("w"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates from 1 with values; the size line is the first that is no comment."""
    rows = numbered(spark, path, lambda x: _written(x) & ~F.startswith(x, F.lit("%")))
    f = rows.where("idx > 0").select(F.split(F.trim("line"), r"\s+").alias("f"))
    return f.select((_n(0) - 1).alias("src"), (_n(1) - 1).alias("dst"), F.get("f", F.lit(2)).cast("double").alias("w"))


def read_node_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of node, degree, neighbours."""
    f = _fields(spark, path)
    return f.select(_n(0).alias("src"), F.explode(F.slice("f", 3, F.greatest(F.size("f"), F.lit(1))).cast("array<long>")).alias("dst")).withColumn("w", F.lit(None).cast("double"))


def read_adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """``node: neighbours`` lines."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", ":").alias("p"))
    return parts.select(F.trim(F.get("p", F.lit(0))).cast("long").alias("src"), F.explode(F.filter(F.split(F.get("p", F.lit(1)), r"\s+"), lambda x: x != "").cast("array<long>")).alias("dst")).withColumn("w", F.lit(None).cast("double"))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """Line i + 1 holds the neighbours of node i, ids from 1."""
    lines = numbered(spark, path).where("idx > 0 and trim(line) <> ''")
    return lines.select((F.col("idx") - 1).alias("src"), F.explode(F.split(F.trim("line"), r"\s+").cast("array<long>")).alias("d")).select("src", (F.col("d") - 1).alias("dst"), F.lit(None).cast("double").alias("w"))


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(row, label, feature, value): one bipartite edge for each pair."""
    rows = numbered(spark, path, _written).select(F.col("idx").alias("row"), F.split(F.trim("line"), r"\s+").alias("f"))
    pairs = rows.select("row", F.get("f", F.lit(0)).cast("double").alias("label"), F.explode(F.slice("f", 2, F.greatest(F.size("f"), F.lit(1)))).alias("p"))
    return pairs.select("row", "label", F.substring_index("p", ":", 1).cast("long").alias("feature"), F.substring_index("p", ":", -1).cast("double").alias("value"))


def read_konect(spark: SparkSession, path: str) -> DataFrame:
    """(v, h): bipartite lines from 1, ``%`` comments."""
    return _fields(spark, path, "%").select((_n(0) - 1).alias("v"), (_n(1) - 1).alias("h"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """(v, h): every line is one group of members."""
    rows = numbered(spark, path, _written)
    return rows.select(F.explode(F.split(F.trim("line"), r"\s+").cast("array<long>")).alias("v"), F.col("idx").alias("h"))


def clique_expansion(members: DataFrame) -> DataFrame:
    """(src, dst): distinct pairs inside hyperedges, both directions: the pairs are what this format is."""
    a, b = members.select("h", F.col("v").alias("src")), members.select("h", F.col("v").alias("dst"))
    return a.join(b, "h").where("src <> dst").select("src", "dst").distinct()


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, new): line n holds the old id of new node n."""
    return numbered(spark, path, _written).select(F.trim("line").cast("long").alias("id"), F.col("idx").alias("new"))


def _decoded(raw: DataFrame, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield decode(content)

    return raw.select("content").mapInPandas(run, schema)


def _frame(offsets: np.ndarray, dst: np.ndarray, w: np.ndarray | None) -> pd.DataFrame:
    src = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(dst))))
    return pd.DataFrame({"src": src, "dst": dst.astype(np.int64), "w": w.astype(float) if w is not None else np.full(len(dst), np.nan)})


def ranges(begins: DataFrame, m: int) -> DataFrame:
    """(idx, begin, end) of begins (idx, x); the last range ends at ``m``."""
    after = begins.select((F.col("idx") - 1).alias("idx"), F.col("x").alias("end"))
    return begins.withColumnRenamed("x", "begin").join(after, "idx", "left").withColumn("end", F.coalesce("end", F.lit(m)))


def adjacent(ranges: DataFrame, targets: DataFrame, weights: DataFrame | None = None, bin_size: int = 256) -> DataFrame:
    """(src, dst, w): the vertex whose range holds a target's place, found by an equi-join on bins of places."""
    bins = ranges.where("end > begin").select(F.col("idx").alias("src"), "begin", "end", F.explode(F.sequence(F.expr(f"begin div {bin_size}"), F.expr(f"(end - 1) div {bin_size}"))).alias("bin"))
    e = targets.select(F.col("idx").alias("at"), F.col("x").alias("dst"))
    e = e.withColumn("w", F.lit(None).cast("double")) if weights is None else e.join(weights.select(F.col("idx").alias("at"), F.col("x").cast("double").alias("w")), "at")
    e = e.withColumn("bin", F.expr(f"at div {bin_size}")).join(bins, "bin").where("at >= begin and at < end")
    return e.select("src", "dst", "w")


def _stretch(x: DataFrame, at: int, count: int, kind: str = "long") -> DataFrame:
    own = (F.col("idx") >= at) & (F.col("idx") < at + count)
    return x.where(own).select((F.col("idx") - at).alias("idx"), F.when(own, F.col("line").cast(kind)).alias("x"))  # a cast may be moved before a filter


def _tokens(spark: SparkSession, path: str, count: int) -> tuple[DataFrame, str, list[int]]:
    """The words of a file, numbered; its first word, and the ``count`` numbers after it."""
    x = numbered(spark, path, _written, words=True)
    head = [r.line for r in x.where(F.col("idx") <= count).orderBy("idx").collect()]
    return x, head[0], [int(v) for v in head[1:]]


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """AdjacencyGraph and WeightedAdjacencyGraph: header, n, m, n offsets, m targets and, if weighted, m weights."""
    x, name, (n, m) = _tokens(spark, path, 2)
    weights = _stretch(x, 3 + n + m, m, "double") if name.startswith("Weighted") else None
    return adjacent(ranges(_stretch(x, 3, n), m), _stretch(x, 3 + n, m), weights)


def read_hyper_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(v, h) of AdjacencyHypergraph: nv, mv, nh, mh, nv offsets, mv hyperedges; the second half repeats it by hyperedge."""
    x, _, (nv, mv, _, _) = _tokens(spark, path, 4)
    return adjacent(ranges(_stretch(x, 5, nv), mv), _stretch(x, 5 + nv, mv)).select(F.col("src").alias("v"), F.col("dst").alias("h"))


def decode_gr(raw: bytes) -> pd.DataFrame:
    """Binary graph, versions 1 and 2: u64 version, edge size, n, m; u64 end offsets; u32 or u64 targets, padded to 8; edge data."""
    version, size, n, m = struct.unpack_from("<4Q", raw)
    ends = np.frombuffer(raw, "<u8", n, 32).astype(np.int64)
    kind = "<u4" if version == 1 else "<u8"
    at = 32 + 8 * n
    dst = np.frombuffer(raw, kind, m, at)
    at += dst.nbytes + (-dst.nbytes) % 8
    w = np.frombuffer(raw, {4: "<u4", 8: "<u8"}[size], m, at) if size else None
    return _frame(np.concatenate([[0], ends[:-1]]) if n else ends, dst, w)


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark.read.format("binaryFile").load(path), decode_gr, EDGES)


def road_rows(content: bytes, at: int, first: int, together: int = 1 << 16) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Vertices and edges of the records from byte ``at`` on, the first being vertex ``first``: a pair of tables as soon as there are ``together`` rows."""
    from ..operators.analytics import EARTH_CM

    places, ends, dst, dist, held = [], [], [], [], 0
    while at < len(content):
        lat, lon, deg = struct.unpack_from("<2dI", content, at)
        places.append((lat, lon))
        ends.append(deg)
        dst.append(np.frombuffer(content, "<u4", deg, at + 20))
        dist.append(np.frombuffer(content, "<f8", deg, at + 20 + 4 * deg))
        at += 20 + 12 * deg
        held += 1 + deg
        if held >= together or at >= len(content):
            ids = np.arange(first, first + len(ends))
            lats, lons = np.array(places).T
            yield pd.DataFrame({"id": ids, "lat": lats, "lon": lons}), pd.DataFrame({"src": np.repeat(ids, ends), "dst": np.concatenate(dst).astype(np.int64), "w": (np.concatenate(dist) * EARTH_CM).astype(np.int64)})
            first += len(ends)
            places, ends, dst, dist, held = [], [], [], [], 0


def road_of(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, lat, lon), edges (src, dst, w)) of road files (content): magic, n, then per vertex lat, lon, degree, neighbours, distances scaled to cm."""

    def vertices(content: bytes) -> Iterator[pd.DataFrame]:
        return (v for v, _ in road_rows(content, 8, 0))

    def edges(content: bytes) -> Iterator[pd.DataFrame]:
        return (e for _, e in road_rows(content, 8, 0))

    def decoded(decode: Callable, schema: str) -> DataFrame:
        return raw.select("content").mapInPandas(lambda batches: (t for b in batches for content in b["content"] for t in decode(content)), schema)

    return decoded(vertices, "id long, lat double, lon double"), decoded(edges, "src long, dst long, w long")


def read_road(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As road_of, of the files at ``path``."""
    return road_of(spark.read.format("binaryFile").load(path))


def read_sequence(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(idx, x) of a sequence file: a header line, then one value a line."""
    return numbered(spark, path, _written).where("idx > 0").select((F.col("idx") - 1).alias("idx"), F.trim("line").cast(kind).alias("x"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(idx, x, y, z) of a point file in 2 or 3 dimensions."""
    rows = read_sequence(spark, path, "string").select("idx", F.split(F.trim("x"), r"\s+").alias("f"))
    return rows.select("idx", *[F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def read_triangles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, triangles (idx, a, b, c from 0)) of a triangle file: header, n, m, n points, m triangles from 1."""
    rows = read_sequence(spark, path, "string")
    n = int(rows.where("idx = 0").first()["x"])
    f = rows.select("idx", F.split(F.trim("x"), r"\s+").alias("f"))
    points = f.where((F.col("idx") >= 2) & (F.col("idx") < 2 + n)).select((F.col("idx") - 2).alias("idx"), *[F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    return points, f.where(F.col("idx") >= 2 + n).select((F.col("idx") - 2 - n).alias("idx"), *[(F.get("f", F.lit(i)).cast("long") - 1).alias(c) for i, c in enumerate("abc")])


def write_lines(rows: DataFrame, line: Column, order: list[str], path: str, head: list[str] = ()) -> None:
    """Text part files in order; the head lines are a part of their own that sorts first."""
    body = rows.select(F.lit(1).alias("__s"), *[F.col(c).cast("double").alias(f"__k{i}") for i, c in enumerate(order)], line.alias("value"))
    if head:
        top = rows.sparkSession.createDataFrame([(0, *[float(i)] * len(order), h) for i, h in enumerate(head)], body.schema)
        body = top.unionByName(body)
    body.orderBy("__s", *[f"__k{i}" for i in range(len(order))]).select("value").write.text(path)


def _w(e: DataFrame) -> Column:
    return F.when(F.col("w").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("w").cast("string")))


def write_edge_list(e: DataFrame, path: str, base: int = 0) -> None:
    write_lines(e, F.concat((F.col("src") + base).cast("string"), F.lit(" "), (F.col("dst") + base).cast("string"), _w(e)), ["src", "dst"], path)


def write_edge_array(e: DataFrame, path: str) -> None:
    weighted = not e.where("w is not null").isEmpty()
    write_lines(e, F.concat_ws(" ", F.col("src").cast("string"), F.concat(F.col("dst").cast("string"), _w(e))), ["src", "dst"], path, ["WeightedEdgeArray" if weighted else "EdgeArray"])


def write_dimacs(e: DataFrame, path: str, n: int) -> None:
    write_lines(e, F.concat(F.lit("a "), (F.col("src") + 1).cast("string"), F.lit(" "), (F.col("dst") + 1).cast("string"), _w(e)), ["src", "dst"], path, [f"p sp {n} {e.count()}"])


def write_matrix_market(e: DataFrame, path: str, n: int) -> None:
    write_lines(e, F.concat((F.col("src") + 1).cast("string"), F.lit(" "), (F.col("dst") + 1).cast("string"), _w(e)), ["src", "dst"], path, ["%%MatrixMarket matrix coordinate real general", f"{n} {n} {e.count()}"])


def write_adjacency_lists(e: DataFrame, path: str) -> None:
    lists = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("n"))
    write_lines(lists, F.concat(F.col("src").cast("string"), F.lit(": "), F.concat_ws(" ", F.col("n").cast("array<string>"))), ["src"], path)


def write_node_lists(e: DataFrame, path: str) -> None:
    lists = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("n"))
    write_lines(lists, F.concat_ws(" ", F.col("src").cast("string"), F.size("n").cast("string"), F.concat_ws(" ", F.col("n").cast("array<string>"))), ["src"], path)


def write_neighbour_weights(e: DataFrame, path: str) -> None:
    """Per node: node, degree, then neighbour and weight pairs."""
    lists = e.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("n"))
    pairs = F.concat_ws(" ", F.transform("n", lambda x: F.concat(x["dst"].cast("string"), F.lit(" "), x["w"].cast("string"))))
    write_lines(lists, F.concat_ws(" ", F.col("src").cast("string"), F.size("n").cast("string"), pairs), ["src"], path)


def write_metis(e: DataFrame, path: str, n: int) -> None:
    """Of a symmetric graph; loops are left out."""
    own = e.where("src <> dst")
    lists = e.sparkSession.range(n).select(F.col("id").alias("src")).join(own.groupBy("src").agg(F.array_sort(F.collect_list(F.col("dst") + 1)).alias("n")), "src", "left")
    write_lines(lists, F.concat_ws(" ", F.col("n").cast("array<string>")), ["src"], path, [f"{n} {own.count() // 2}"])


def write_csv_pair(vertices: DataFrame, e: DataFrame, path: str) -> None:
    """Vertex and edge CSV folders with headers."""
    vertices.write.csv(f"{path}/vertices", header=True)
    e.write.csv(f"{path}/edges", header=True)


def write_adjacency(e: DataFrame, vertices: DataFrame, path: str) -> None:
    """AdjacencyGraph text of vertices 0 .. n - 1, weighted if the edges are."""
    from ..operators.graph import offsets

    weighted = not e.where("w is not null").isEmpty()
    n, m = vertices.count(), e.count()
    body = offsets(e, vertices).select(F.lit(0).alias("s"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("offset").cast("string").alias("v"))
    body = body.unionByName(e.select(F.lit(1).alias("s"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("v")))
    if weighted:
        body = body.unionByName(e.select(F.lit(2).alias("s"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").cast("string").alias("v")))
    write_lines(body, F.col("v"), ["s", "a", "b"], path, ["WeightedAdjacencyGraph" if weighted else "AdjacencyGraph", str(n), str(m)])


def encode_gr(e: pd.DataFrame, n: int, version: int = 1) -> bytes:
    """The bytes of a binary graph of edges (src, dst, w)."""
    e = e.sort_values(["src", "dst"], kind="stable")
    ends = np.cumsum(np.bincount(e["src"], minlength=n)).astype("<u8")
    dst = e["dst"].to_numpy().astype("<u4" if version == 1 else "<u8").tobytes()
    weighted = bool(e["w"].notna().all()) and len(e) > 0
    data = e["w"].to_numpy().astype("<u4").tobytes() if weighted else b""
    return struct.pack("<4Q", version, 4 if weighted else 0, n, len(e)) + ends.tobytes() + dst + b"\0" * (-len(dst) % 8) + data


def write_hyper_adjacency(members: DataFrame, nv: int, nh: int, path: str) -> None:
    """AdjacencyHypergraph text of memberships (v, h) of vertices 0 .. nv - 1 and hyperedges 0 .. nh - 1: by vertex, then by hyperedge."""
    from ..operators.graph import offsets

    spark, m = members.sparkSession, members.count()
    body = None
    for s, (a, b, n) in enumerate((("v", "h", nv), ("h", "v", nh))):
        side = members.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        starts = offsets(side, spark.range(n)).select(F.lit(2 * s).alias("s"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("offset").cast("string").alias("v"))
        targets = side.select(F.lit(2 * s + 1).alias("s"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("v"))
        part = starts.unionByName(targets)
        body = part if body is None else body.unionByName(part)
    write_lines(body, F.col("v"), ["s", "a", "b"], path, ["AdjacencyHypergraph", str(nv), str(m), str(nh), str(m)])


def write_sequence(seq: DataFrame, path: str, name: str = "sequenceInt") -> None:
    """A sequence file of (idx, x): a header line, then one value a line."""
    write_lines(seq, F.col("x").cast("string"), ["idx"], path, [name])


def write_points(points: DataFrame, path: str, dims: int = 2, head: str = "sequencePoint2d") -> None:
    """A point file of (idx, x, y[, z]) under the header line that its readers want."""
    write_lines(points, F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"[:dims]]), ["idx"], path, [head])


def write_triangles(points: DataFrame, triangles: DataFrame, path: str, head: str = "triangles") -> None:
    """A triangle file of points (idx, x, y) and triangles (idx, a, b, c from 0) under the header line that its readers want."""
    body = points.select(F.lit(0).alias("s"), "idx", F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("v"))
    body = body.unionByName(triangles.select(F.lit(1).alias("s"), "idx", F.concat_ws(" ", *[(F.col(c) + 1).cast("string") for c in "abc"]).alias("v")))
    write_lines(body, F.col("v"), ["s", "idx"], path, [head, str(points.count()), str(triangles.count())])


def write_svmlight(pairs: DataFrame, path: str) -> None:
    """Lines of label and feature:value pairs of (row, label, feature, value), in order of rows."""
    lists = pairs.groupBy("row").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"))
    write_lines(lists, F.concat_ws(" ", F.col("label").cast("string"), F.concat_ws(" ", F.transform("f", lambda x: F.concat(x["feature"].cast("string"), F.lit(":"), x["value"].cast("string"))))), ["row"], path)


def write_konect(members: DataFrame, path: str) -> None:
    """Bipartite lines from 1 of (v, h)."""
    write_lines(members, F.concat_ws(" ", (F.col("v") + 1).cast("string"), (F.col("h") + 1).cast("string")), ["v", "h"], path, ["% bip unweighted"])


def write_communities(members: DataFrame, path: str) -> None:
    """A line of members for each group of (v, h), in order of h; groups without members are not written."""
    lists = members.groupBy("h").agg(F.array_sort(F.collect_set("v")).alias("n"))
    write_lines(lists, F.concat_ws(" ", F.col("n").cast("array<string>")), ["h"], path)


def write_path(way: DataFrame, path: str) -> None:
    """A way (step, id, dist): a line of its ends and length, then a vertex a line."""
    ends = way.agg(F.min_by("id", "step").alias("a"), F.max_by("id", "step").alias("b"), F.max("dist").alias("d")).first()
    write_lines(way, F.col("id").cast("string"), ["step"], path, [] if ends.a is None else [f"{ends.a} {ends.b} {ends.d}"])


def encode_road(vertices: pd.DataFrame, edges: pd.DataFrame, magic: int = 0x12345678) -> bytes:
    """The bytes of a road file of vertices (lat, lon) 0 .. n - 1 and edges (src, dst, w in cm)."""
    from ..operators.analytics import EARTH_CM

    out = [struct.pack("<2I", magic, len(vertices))]
    by = {k: g for k, g in edges.groupby("src")}
    for i, (lat, lon) in enumerate(zip(vertices["lat"], vertices["lon"], strict=True)):
        own = by.get(i)
        n = 0 if own is None else len(own)
        out.append(struct.pack("<2dI", lat, lon, n))
        if n:
            out += [own["dst"].to_numpy().astype("<u4").tobytes(), ((own["w"].to_numpy() + 0.5) / EARTH_CM).astype("<f8").tobytes()]
    return b"".join(out)


def write_gr(e: DataFrame, path: str, n: int, version: int = 1) -> None:
    """A binary graph file on the driver's file system: one file is one object; use Parquet for graphs beyond its memory."""
    with open(path, "wb") as f:
        f.write(encode_gr(e.select("src", "dst", "w").toPandas(), n, version))


def trip(name: str, write: Callable, read: Callable, weighted: bool = True):
    """Registers the round trip of the order graph, repeats dropped, through a format."""
    from ..operators.graph import G

    def run(s, d):
        from ..operators.graph import cleanup, order_graph, vertices_of

        e = cleanup(order_graph(s, d)).select("src", "dst", F.col("w").cast("double").alias("w"))
        e = e if weighted else e.withColumn("w", F.lit(None).cast("double"))
        path = scratch(s)
        write(e, vertices_of(s, d), path)
        out = read(s, path)
        return out.select("src", "dst", F.col("w").cast("long").alias("w")) if weighted else out.select("src", "dst")

    register(f"round_trip_{name}", f"select src, dst, min(w) as w from {G} where src <> dst group by 1, 2" if weighted else f"select distinct src, dst from {G} where src <> dst")(run)


trip("edge_list", lambda e, v, p: write_edge_list(e, p), read_edge_list)
trip("edge_list_from_1", lambda e, v, p: write_edge_list(e, p, 1), lambda s, p: read_edge_list(s, p, base=1))
trip("edge_array", lambda e, v, p: write_edge_array(e, p), read_edge_array)
trip("csv", lambda e, v, p: e.write.csv(p), read_csv_edges)
trip("dimacs", lambda e, v, p: write_dimacs(e, p, v.count()), read_dimacs)
trip("adjacency_list", lambda e, v, p: write_adjacency_lists(e, p), read_adjacency_list, False)
trip("matrix_market", lambda e, v, p: write_matrix_market(e, p, v.count()), read_matrix_market)
trip("adjacency_graph", write_adjacency, read_adjacency)
trip("node_list", lambda e, v, p: write_node_lists(e, p), read_node_list, False)


def _members(s, d) -> DataFrame:
    """(v, h): the parts of each order."""
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("h")).distinct()


def _through(write: Callable, read: Callable) -> Callable:
    """What ``read`` makes of what ``write`` wrote of the tables of (spark, sf_dir)."""

    def run(s, d):
        path = scratch(s)
        write(s, d, path)
        return read(s, path)

    return run


def _orders(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").cast("long").alias("x"))


def _points(s, d) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") * 0.5).alias("z"))


def _triangle_rows(s, d, path: str) -> None:
    p = _points(s, d)
    write_triangles(p, p.select("idx", *[F.col("idx").alias(c) for c in "abc"]), path)


def _feature_rows(s, d) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def _svm(s, d, path: str) -> None:
    from ..operators.sequence import dense

    rows = _feature_rows(s, d)
    names = dense(rows.select("o").distinct(), ["o"]).select("o", F.col("idx").alias("row"))
    write_svmlight(rows.join(names, "o").select("row", (F.col("o") % 2).cast("double").alias("label"), "feature", "value"), path)


def _way(s, d, path: str) -> None:
    from ..operators.analytics import bfs
    from ..operators.analytics import path as way
    from ..operators.graph import order_graph

    write_path(way(bfs(order_graph(s, d), 0), 77), path)


_MEM = "(select distinct l_partkey as v, l_orderkey as h from lineitem)"
register("round_trip_hypergraph", f"select v, h from {_MEM}")(_through(lambda s, d, p: write_hyper_adjacency(m := stored(_members(s, d)), 1 + m.agg(F.max("v")).first()[0], 1 + m.agg(F.max("h")).first()[0], p), read_hyper_adjacency))
register("round_trip_konect", f"select v, h from {_MEM}")(_through(lambda s, d, p: write_konect(_members(s, d), p), read_konect))
register("round_trip_communities", f"select v, dense_rank() over (order by h) - 1 as h from {_MEM}")(_through(lambda s, d, p: write_communities(_members(s, d), p), read_communities))
register("clique_expansion", f"select distinct a.v as src, b.v as dst from {_MEM} a join {_MEM} b on a.h = b.h where a.v <> b.v")(_through(lambda s, d, p: write_konect(_members(s, d), p), lambda s, p: clique_expansion(read_konect(s, p))))
register("community_cliques", f"select distinct a.v as src, b.v as dst from {_MEM} a join {_MEM} b on a.h = b.h where a.v <> b.v")(_through(lambda s, d, p: write_communities(_members(s, d), p), lambda s, p: clique_expansion(read_communities(s, p))))
register("round_trip_sequence", "select o_orderkey as idx, cast(floor(o_totalprice) as bigint) as x from orders")(_through(lambda s, d, p: write_sequence(_orders(s, d), p), lambda s, p: read_sequence(s, p, "long")))
register("round_trip_points", "select p_partkey as idx, cast(p_size as double) as x, p_retailprice as y, p_partkey * 0.5e0 as z from part")(_through(lambda s, d, p: write_points(_points(s, d), p, 3, "sequencePoint3d"), read_points))
register("round_trip_triangles", "select p_partkey as idx, p_partkey as a, p_partkey as b, p_partkey as c from part")(_through(_triangle_rows, lambda s, p: read_triangles(s, p)[1]))
register("round_trip_svmlight", "select dense_rank() over (order by o) - 1 as row, cast(o % 2 as double) as label, feature, value from (select l_orderkey as o, l_partkey as feature, sum(l_quantity) as value from lineitem group by 1, 2)")(_through(_svm, read_svmlight))


def _metis(s, d, path: str) -> None:
    from ..operators.graph import order_graph, undirected, vertices_of

    write_metis(undirected(order_graph(s, d)), path, vertices_of(s, d).count())


def _register_graph_files() -> None:
    from ..operators.graph import UND

    register("round_trip_metis", f"select src, dst from {UND}")(_through(_metis, lambda s, p: read_metis(s, p).select("src", "dst")))


_register_graph_files()
trip("csv_pair", lambda e, v, p: write_csv_pair(v, e.select("src", "dst", "w"), p), lambda s, p: s.read.csv(f"{p}/edges", schema=EDGES, header=True))


def _road_edges(s, d) -> DataFrame:
    """A road file of the customers and their order edges, written and read in parts."""
    from ..operators.graph import order_graph
    from .binary import read_road_parts, write_road

    v = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 0.001).alias("lat"), (F.col("c_custkey") * 0.002).alias("lon"))
    path = scratch(s)
    write_road(v, order_graph(s, d), path)
    return read_road_parts(s, path)[1]


register("round_trip_road", "select o_custkey as src, (o_orderkey * 31 + 7) % (select count(*) from customer) as dst, 1 + o_orderkey % 10 as w from orders")(_road_edges)
