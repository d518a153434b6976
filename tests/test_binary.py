"""Binary files byte by byte, in many parts and in one piece."""

import pathlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.sources import binary, formats

EDGES = [(0, 1, 5), (0, 3, 2), (1, 0, 9), (3, 2, 7), (3, 3, 1)]


@pytest.fixture
def graph(spark):
    return spark.createDataFrame(EDGES, "src long, dst long, w long").repartition(3), spark.range(5)


def joined(path):
    return b"".join(p.read_bytes() for p in sorted(pathlib.Path(path).glob("part-*")))


def rows(df):
    return sorted((r.src, r.dst, r.w) for r in df.collect())


def test_binary_graph(graph, spark, tmp_path):
    e, v = graph
    for version in (1, 2):
        path = str(tmp_path / f"g{version}")
        binary.write_gr_parts(e, v, path, version)
        raw = joined(path)
        assert raw == formats.encode_gr(e.toPandas(), 5, version)
        (tmp_path / f"one{version}").write_bytes(raw)
        assert rows(binary.read_gr_parts(spark, path)) == rows(binary.read_gr_parts(spark, str(tmp_path / f"one{version}"))) == EDGES
        assert rows(formats.read_gr(spark, str(tmp_path / f"one{version}"))) == EDGES


def test_matrices(graph, spark, tmp_path):
    e, _ = graph
    binary.write_petsc(e, 5, 5, str(tmp_path / "p"), ">", "f4")
    assert joined(tmp_path / "p") == struct.pack(">4i5i5i5f", 1211216, 5, 5, 5, 2, 1, 0, 2, 0, 1, 3, 0, 2, 3, 5, 2, 9, 7, 1)
    with pytest.raises(ValueError):
        binary.read_petsc(spark, str(tmp_path / "p"))
    binary.write_sparse_matrix(e.withColumn("w", F.lit(None)), 5, str(tmp_path / "m"))
    assert joined(tmp_path / "m") == struct.pack("<3I5I5I5d", 5, 5, 5, 0, 0, 1, 3, 3, 1, 3, 0, 2, 3, *[1.0] * 5)
    assert binary.bipartite_rows(e.where("src < 2"), spark.range(5)) == 2


def test_adjacency_files(graph, spark, tmp_path):
    e, v = graph
    binary.write_binary_adjacency(e, v, str(tmp_path / "a"))
    assert np.frombuffer(joined(tmp_path / "a.idx"), "<u8").tolist() == [0, 2, 3, 3, 5]
    assert np.frombuffer(joined(tmp_path / "a.adj"), "<u4").tolist() == [1, 3, 0, 2, 3, 5, 2, 9, 7, 1]
    assert rows(binary.read_binary_adjacency(spark, str(tmp_path / "a"), True)) == EDGES
    binary.write_incoming(e, v, str(tmp_path / "i"))
    assert joined(tmp_path / "i") == struct.pack("<IQ5Q5I5I", 5, 5, 1, 2, 3, 5, 5, 1, 0, 3, 0, 3, 9, 5, 7, 2, 1)


def test_repeated_edges_and_empty_graphs(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 3)] * 5000 + [(2, 1, 3)], "src long, dst long, w long")
    binary.write_binary_edges(e, str(tmp_path / "r"))
    assert joined(tmp_path / "r") == struct.pack("<2I", 1, 2) * 5000 + struct.pack("<2I", 2, 1)
    none = e.where("src < 0")
    binary.write_gr_parts(none, spark.range(2), str(tmp_path / "n"))
    assert joined(tmp_path / "n") == struct.pack("<6Q", 1, 0, 2, 0, 0, 0)
    assert rows(binary.read_gr_parts(spark, str(tmp_path / "n"))) == []
    assert not [p for p in tmp_path.rglob("_*") if p.name != "_SUCCESS"]
