"""Binary graph files, written and read in parts by many tasks.

A file is a list of sections of fixed-width numbers. A sink sorts the numbers
of all sections by place; each task encodes its stretch, and the parts joined
in name order are the file. A source computes from the parts' lengths which
place each holds and decodes them side by side, a part being one task's work;
a file in one piece is one part. Parts appear under their names only when all
tasks are done, so retried and lost tasks leave nothing behind.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..registry import register
from ..tables import scratch
from .formats import adjacent, ranges, road_rows, trip


@dataclass
class Written(WriterCommitMessage):
    """Names of one task's part, before and after the commit."""

    held: str
    name: str


class PartsWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator) -> Written:
        system, root = self._root()
        held, name, out = f"{root}/_{uuid.uuid4().hex}", "", None
        for row in iterator:
            if out is None:
                system.create_dir(root, recursive=True)
                out, name = system.open_output_stream(held), f"{root}/part-{row.part:08d}"
            out.write(bytes(row.value))
        if out is not None:
            out.close()
        return Written(held, name)

    def commit(self, messages: list) -> None:
        system, root = self._root()
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(m.held, m.name)

    def abort(self, messages: list) -> None:
        system, _ = self._root()
        for m in messages:
            if m is not None and m.name:
                system.delete_file(m.held)


class Parts(DataSource):
    """Sink of rows (part, value): the values of a task, in order, become the file of its part."""

    @classmethod
    def name(cls) -> str:
        return "loomframe_parts"

    def schema(self) -> str:
        return "part int, value binary"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"])


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _carried(real: bool) -> tuple:
    """The number of a row as x or, of a section of fractions, as r: whole numbers keep all of their bits."""
    return (F.lit(None).cast("long") if real else F.col("x").cast("long")).alias("x"), (F.col("x").cast("double") if real else F.lit(None).cast("double")).alias("r")


def write_sections(sections: list[tuple[DataFrame, str]], path: str) -> None:
    """Writes sections in order, each rows (a, b, x) or (a, b, c, x) sorted by the columns before x, with x in a NumPy number format."""
    rows = None
    for i, (df, _) in enumerate(sections):
        part = df.select(F.lit(i).alias("s"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (F.col("c") if "c" in df.columns else F.lit(0)).cast("long").alias("c"), *_carried(np.dtype(sections[i][1]).kind == "f"))
        rows = part if rows is None else rows.unionByName(part)
    kinds = [k for _, k in sections]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, whole, real = batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
                raw = b"".join((real if np.dtype(kinds[s[i]]).kind == "f" else whole)[i:j].astype(kinds[s[i]]).tobytes() for i, j in zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([raw], pa.binary())], names=["part", "value"])

    spark = rows.sparkSession
    spark.dataSource.register(Parts)
    encoded = rows.orderBy("s", "a", "b", "c").select(F.spark_partition_id().alias("part"), "s", "x", "r").mapInArrow(run, "part int, value binary")
    encoded.write.format(Parts.name()).mode("append").save(_uri(path))


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, first byte, length) of the parts: as many rows as files."""
    out, at = [], 0
    for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect():
        out.append((r.path, at, r.length))
        at += r.length
    return out


def write_road(vertices: DataFrame, edges: DataFrame, path: str, magic: int = 0x12345678) -> None:
    """Writes a road file of vertices (id, lat, lon), ids dense from 0, and edges (src, dst, w in cm), as ``formats.encode_road`` has it. A part holds whole records."""
    from ..operators.analytics import EARTH_CM

    spark, n = vertices.sparkSession, vertices.count()
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", F.col("w").cast("double").alias("w")))).alias("e"))
    records = vertices.select("id", "lat", "lon").join(lists, "id", "left").select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("e.dst").alias("dst"), F.col("e.w").alias("w"))
    head = spark.createDataFrame([(-1,)], "id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, lat, lon, dst, w in zip(*batch.columns[1:], strict=True):
                if i.as_py() < 0:
                    out.append(struct.pack("<2I", magic, n))
                    continue
                to, far = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0) for x in (dst, w))
                out.append(struct.pack("<2dI", lat.as_py(), lon.as_py(), len(to)) + to.astype("<u4").tobytes() + ((far + 0.5) / EARTH_CM).astype("<f8").tobytes())
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([b"".join(out)], pa.binary())], names=["part", "value"])

    spark.dataSource.register(Parts)
    encoded = records.unionByName(head, allowMissingColumns=True).orderBy("id").select(F.spark_partition_id().alias("part"), "id", "lat", "lon", "dst", "w").mapInArrow(run, "part int, value binary")
    encoded.write.format(Parts.name()).mode("append").save(_uri(path))


def read_road_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, lat, lon), edges (src, dst, w)) of a road file whose parts hold whole records; a file in one piece is one part.

    Each part's records are counted first, which tells the vertex it begins with.
    """
    files = _files(spark, path)
    top = files[0][0] if files else None
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def begin(name: str) -> int:
        return 8 if name == top else 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, at, n = content.as_buffer(), begin(name), 0
                while at < len(held):
                    at, n = at + 20 + 12 * struct.unpack_from("<I", held, at + 16)[0], n + 1
                yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]})

    counts, first, before = {r.path: r.n for r in raw.mapInArrow(count, "path string, n long").collect()}, {}, 0  # a row a part
    for name, _, _ in files:
        first[name] = before
        before += counts[name]

    def decoded(side: int, schema: str) -> DataFrame:
        return raw.mapInPandas(lambda batches: (t[side] for b in batches for name, content in zip(b["path"], b["content"], strict=True) for t in road_rows(content, begin(name), first[name])), schema)

    return decoded(0, "id long, lat double, lon double"), decoded(1, "src long, dst long, w long")


def read_section(spark: SparkSession, path: str, at: int, count: int, kind: str) -> DataFrame:
    """(idx, x): ``count`` numbers of a NumPy format from byte ``at``; only the parts that hold them are opened."""
    size, real = np.dtype(kind).itemsize, np.dtype(kind).kind == "f"
    schema = f"idx long, x {'double' if real else 'long'}"
    near = {f: begin for f, begin, n in _files(spark, path) if begin < at + count * size and begin + n > at}
    if not near:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                begin, content = near[name.as_py()], raw.as_buffer()
                lo, hi = max(at, begin), min(at + count * size, begin + len(content))
                x = np.frombuffer(content, kind, (hi - lo) // size, lo - begin).astype(np.float64 if real else np.int64)
                first = (lo - at) // size
                for i in range(0, len(x), 1 << 16):
                    part = x[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + i, first + i + len(part))), pa.array(part)], names=["idx", "x"])

    return spark.read.format("binaryFile").load(list(near)).select("path", "content").mapInArrow(run, schema)


def _head(spark: SparkSession, path: str, at: int, count: int, kind: str) -> list[int]:
    return [r.x for r in read_section(spark, path, at, count, kind).orderBy("idx").collect()]


def _values(spark: SparkSession, values: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "a long, b long, x long")


def _column(e: DataFrame, name: str) -> DataFrame:
    """A section of one number an edge, in the order of adjacency."""
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(name).alias("x"))


def _begins(e: DataFrame, vertices: DataFrame) -> DataFrame:
    from ..operators.graph import offsets

    return offsets(e, vertices).select(F.col("id").alias("a"), F.lit(0).alias("b"), F.col("offset").alias("x"))


def _ends(e: DataFrame, vertices: DataFrame, n: int, m: int) -> DataFrame:
    return _begins(e, vertices).where("a > 0").withColumn("a", F.col("a") - 1).unionByName(_values(e.sparkSession, [m]).withColumn("a", F.lit(n - 1).cast("long"))) if n else _values(e.sparkSession, [])


def _begins_of_ends(ends: DataFrame, m: int) -> DataFrame:
    before = ends.select((F.col("idx") + 1).alias("idx"), F.col("x").alias("begin"))
    return ends.withColumnRenamed("x", "end").join(before, "idx", "left").withColumn("begin", F.coalesce("begin", F.lit(0)))


# Pairs of unsigned 32-bit ends.


def write_binary_edges(e: DataFrame, path: str) -> None:
    # repeats are counted, not numbered by arrival, so that a task that runs again gives the same places
    often = e.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg((2 * F.count("*")).alias("n"))
    runs = often.select("a", "b", "n", F.explode(F.expr("sequence(0, (n - 1) div 4096)")).alias("run"))
    places = runs.select("a", "b", F.explode(F.expr("sequence(4096 * run, least(n, 4096 * (run + 1)) - 1)")).alias("c"))
    write_sections([(places.select("a", "b", "c", F.when(F.col("c") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("x")), "<u4")], path)


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    x = read_section(spark, path, 0, sum(n for _, _, n in _files(spark, path)) // 4, "<u4")
    pairs = x.groupBy(F.expr("idx div 2").alias("i")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("x"))).alias("src"), F.max(F.when(F.col("idx") % 2 == 1, F.col("x"))).alias("dst"))
    return pairs.select("src", "dst", F.lit(None).cast("double").alias("w"))


# Binary graphs: u64 version, edge size, n, m; u64 end offsets; targets, padded to 8 bytes; edge data, big-endian if asked.


def write_gr_parts(e: DataFrame, vertices: DataFrame, path: str, version: int = 1, big: bool = False) -> None:
    spark, n, m = e.sparkSession, vertices.count(), e.count()
    weighted = m > 0 and e.where("w is null").isEmpty()
    kind = "<u4" if version == 1 else "<u8"
    sections = [(_values(spark, [version, 4 if weighted else 0, n, m]), "<u8"), (_ends(e, vertices, n, m), "<u8"), (_column(e, "dst"), kind)]
    if version == 1 and m % 2:
        sections.append((_values(spark, [0]), "<u4"))
    write_sections(sections + ([(_column(e, "w"), ">u4" if big else "<u4")] if weighted else []), path)


def read_gr_parts(spark: SparkSession, path: str, big: bool = False) -> DataFrame:
    version, size, n, m = _head(spark, path, 0, 4, "<u8")
    kind, at = ("<u4" if version == 1 else "<u8"), 32 + 8 * n
    targets = read_section(spark, path, at, m, kind)
    used = m * np.dtype(kind).itemsize
    weights = read_section(spark, path, at + used + -used % 8, m, f"{'>' if big else '<'}u{size}") if size else None
    return adjacent(_begins_of_ends(read_section(spark, path, 32, n, "<u8"), m), targets, weights)


# Adjacency in three files: base.config (the number of vertices as text), base.idx (begins), base.adj (targets, then weights).


def write_binary_adjacency(e: DataFrame, vertices: DataFrame, path: str, node: str = "<u4", offset: str = "<u8") -> None:
    spark, n = e.sparkSession, vertices.count()
    weighted = e.where("w is null").isEmpty()
    spark.createDataFrame([(str(n),)], "value string").write.text(path + ".config")
    write_sections([(_begins(e, vertices), offset)], path + ".idx")
    write_sections([(_column(e, "dst"), node)] + ([(_column(e, "w"), node)] if weighted else []), path + ".adj")


def read_binary_adjacency(spark: SparkSession, path: str, weighted: bool = False, node: str = "<u4") -> DataFrame:
    """The width of offsets follows from the size of base.idx."""
    n = int(spark.read.text(path + ".config").first()[0].split()[0])
    size = np.dtype(node).itemsize
    m = sum(k for _, _, k in _files(spark, path + ".adj")) // size // (2 if weighted else 1)
    width = sum(k for _, _, k in _files(spark, path + ".idx")) // max(n, 1)
    begins = read_section(spark, path + ".idx", 0, n, f"<u{width or 8}")
    weights = read_section(spark, path + ".adj", m * size, m, node) if weighted else None
    return adjacent(ranges(begins, m), read_section(spark, path + ".adj", 0, m, node), weights)


def write_binary_hypergraph(members: DataFrame, nv: int, nh: int, path: str) -> None:
    """Of (v, h): base.config with nv, mv, nh, mh; begins and targets by vertex (vidx, vadj) and by hyperedge (hidx, hadj)."""
    spark, m = members.sparkSession, members.count()
    spark.createDataFrame([(f"{nv} {m} {nh} {m}",)], "value string").write.text(path + ".config")
    for side, n, src, dst in (("v", nv, "v", "h"), ("h", nh, "h", "v")):
        e = members.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
        write_sections([(_begins(e, spark.range(n)), "<u4")], f"{path}.{side}idx")
        write_sections([(_column(e, "dst"), "<u4")], f"{path}.{side}adj")


def read_binary_hypergraph(spark: SparkSession, path: str) -> DataFrame:
    """(v, h), from the vertices' side."""
    nv, mv, _, _ = map(int, spark.read.text(path + ".config").first()[0].split())
    e = adjacent(ranges(read_section(spark, path + ".vidx", 0, nv, "<u4"), mv), read_section(spark, path + ".vadj", 0, mv, "<u4"))
    return e.select(F.col("src").alias("v"), F.col("dst").alias("h"))


# Sparse matrices: one with a row count each (magic 1211216), one as three arrays.

PETSC_MAGIC = 1211216


def bipartite_rows(e: DataFrame, vertices: DataFrame) -> int:
    """The rows of a bipartite graph: the vertices before the first one without edges out."""
    first = vertices.select("id").join(e.select(F.col("src").alias("id")), "id", "left_anti").agg(F.min("id")).first()[0]
    return vertices.count() if first is None else first


def write_petsc(e: DataFrame, rows: int, columns: int, path: str, order: str = "<", value: str = "f8") -> None:
    """The matrix with the weight at (src, dst); order is ``<`` or ``>``, value f4 or f8."""
    from ..operators.graph import degrees

    spark = e.sparkSession
    counts = degrees(e, spark.range(rows)).select(F.col("id").alias("a"), F.lit(0).alias("b"), F.col("degree").alias("x"))
    write_sections([(_values(spark, [PETSC_MAGIC, rows, columns, e.count()]), order + "i4"), (counts, order + "i4"), (_column(e, "dst"), order + "i4"), (_column(e, "w"), order + value)], path)


def read_petsc(spark: SparkSession, path: str, order: str = "<", value: str = "f8") -> DataFrame:
    from ..operators.sequence import scan

    magic, rows, _, m = _head(spark, path, 0, 4, order + "i4")
    if magic != PETSC_MAGIC:
        raise ValueError(f"{path} is no matrix file in this byte order")
    begins = scan(read_section(spark, path, 16, rows, order + "i4")).select("idx", F.col("prefix").alias("x"))
    at = 16 + 4 * rows
    return adjacent(ranges(begins, m), read_section(spark, path, at, m, order + "i4"), read_section(spark, path, at + 4 * m, m, order + value))


def write_sparse_matrix(e: DataFrame, n: int, path: str) -> None:
    """u32 n, n, m; u32 rows; u32 columns; f64 values (1 where the weight is null)."""
    weighted = e.withColumn("w", F.coalesce(F.col("w").cast("double"), F.lit(1.0)))
    write_sections([(_values(e.sparkSession, [n, n, e.count()]), "<u4"), (_column(e, "src"), "<u4"), (_column(e, "dst"), "<u4"), (_column(weighted, "w"), "<f8")], path)


def read_sparse_matrix(spark: SparkSession, path: str) -> DataFrame:
    _, _, m = _head(spark, path, 0, 3, "<u4")
    names = (("src", 12, "<u4"), ("dst", 12 + 4 * m, "<u4"), ("w", 12 + 8 * m, "<f8"))
    src, dst, w = (read_section(spark, path, at, m, kind).withColumnRenamed("x", name) for name, at, kind in names)
    return src.join(dst, "idx").join(w, "idx").select("src", "dst", "w")


def write_node_map(names: DataFrame, path: str) -> None:
    """Of (id, new): the old ids, u32, in the order of the new ones."""
    write_sections([(names.select(F.col("new").alias("a"), F.lit(0).alias("b"), F.col("id").alias("x")), "<u4")], path)


def read_node_map(spark: SparkSession, path: str) -> DataFrame:
    return read_section(spark, path, 0, sum(n for _, _, n in _files(spark, path)) // 4, "<u4").select(F.col("x").alias("id"), F.col("idx").alias("new"))


# Incoming edges by vertex: u32 n, u64 m; u64 end offsets; u32 sources; u32 weights if there are any.


def write_incoming(e: DataFrame, vertices: DataFrame, path: str) -> None:
    from ..operators.graph import transpose

    t, spark, n, m = transpose(e), e.sparkSession, vertices.count(), e.count()
    weighted = m > 0 and e.where("w is null").isEmpty()
    write_sections([(_values(spark, [n]), "<u4"), (_values(spark, [m]), "<u8"), (_ends(t, vertices, n, m), "<u8"), (_column(t, "dst"), "<u4")] + ([(_column(t, "w"), "<u4")] if weighted else []), path)


def read_incoming(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.graph import transpose

    (n,), (m,) = _head(spark, path, 0, 1, "<u4"), _head(spark, path, 4, 1, "<u8")
    at = 12 + 8 * n
    weighted = sum(k for _, _, k in _files(spark, path)) >= at + 8 * m > at
    weights = read_section(spark, path, at + 4 * m, m, "<u4") if weighted else None
    return transpose(adjacent(_begins_of_ends(read_section(spark, path, 12, n, "<u8"), m), read_section(spark, path, at, m, "<u4"), weights))


def write_compressed(e: DataFrame, path: str) -> None:
    """Parquet in the order of adjacency without dictionaries: ids are stored as bit-packed differences."""
    e.orderBy("src", "dst").write.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").parquet(path)


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


trip("binary_edges", lambda e, v, p: write_binary_edges(e, p), read_binary_edges, False)
trip("gr", write_gr_parts, read_gr_parts)
trip("gr_big_endian", lambda e, v, p: write_gr_parts(e, v, p, 2, True), lambda s, p: read_gr_parts(s, p, True))
trip("binary_adjacency", write_binary_adjacency, read_binary_adjacency, False)
trip("binary_adjacency_weighted", lambda e, v, p: write_binary_adjacency(e, v, p, offset="<u4"), lambda s, p: read_binary_adjacency(s, p, True))
trip("petsc", lambda e, v, p: write_petsc(e, v.count(), v.count(), p), read_petsc)
trip("petsc_big_endian", lambda e, v, p: write_petsc(e, v.count(), v.count(), p, ">", "f4"), lambda s, p: read_petsc(s, p, ">", "f4"))
trip("sparse_matrix", lambda e, v, p: write_sparse_matrix(e, v.count(), p), read_sparse_matrix)
trip("incoming", write_incoming, read_incoming)
trip("compressed", lambda e, v, p: write_compressed(e, p), read_compressed)


@register("round_trip_node_map", "select c_custkey as id, (select max(c_custkey) from customer) - c_custkey as new from customer")
def round_trip_node_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import vertices_of

    ids = vertices_of(spark, sf_dir)
    most = ids.agg(F.max("id")).first()[0]
    path = scratch(spark)
    write_node_map(ids.select("id", (F.lit(most) - F.col("id")).alias("new")), path)
    return read_node_map(spark, path)


@register("round_trip_binary_hypergraph", "select distinct l_orderkey as v, l_partkey as h from lineitem")
def round_trip_binary_hypergraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..tables import table

    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_partkey").alias("h")).distinct()
    most = members.agg(F.max("v"), F.max("h")).first()
    path = scratch(spark)
    write_binary_hypergraph(members, most[0] + 1, most[1] + 1, path)
    return read_binary_hypergraph(spark, path)
