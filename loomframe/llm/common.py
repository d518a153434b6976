"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    It is set here only where it is unset and the master is local; a cluster
    without the setting is an error, because a machine-local folder would lose
    data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    spark.conf.set("spark.checkpoint.dir", found)
    _OWNED.append((spark, found))
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomframe-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OWNED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Deletes a table of :func:`materialise` that nothing reads any more, such as the round before the last of an iteration."""
    path = getattr(df, "_written", None)
    if path:
        _delete(df.sparkSession, path)
        _OWNED.remove((df.sparkSession, path))


def release() -> None:
    """Deletes what :func:`materialise` wrote. Results that still read it must have been consumed."""
    while _OWNED:
        spark, path = _OWNED.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; the folder is scratch space
            return


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under its own names, so that other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: log2 of the bits of the set that tells which ids a join asks for, 64 of them a row.
ID_BITS = 22


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose id is not in ``ids`` (one column), and the others, so that a join on ids moves only these.

    The second part has every row whose id is in ``ids`` and, while those are
    fewer than the bits of the set, few others. The set has a fixed size.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS))
    bits = ids.toDF("__id").select(slot(F.col("__id").cast("long")).alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__slot & 63 as int))")).alias("__bits"))
    out = df.withColumn("__slot", slot(F.col(id_col).cast("long"))).withColumn("__at", F.shiftright("__slot", 6))
    out = out.join(F.broadcast(bits), "__at", "left")  # 2**(ID_BITS - 6) rows of two numbers at most, whatever the corpus
    out = out.withColumn("__asked", F.coalesce(F.expr("shiftright(__bits, cast(__slot & 63 as int)) & 1") == 1, F.lit(False)))
    return tuple(out.where(F.col("__asked") == side).select(*df.columns) for side in (False, True))


def code_points(c: Column) -> Column:
    return F.char_length(c).cast("long")


#: Edges that one file, and one task of the last stage of a round, has on average at least.
EDGES_A_FILE = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links``: rows (node, component), component the smallest node in reach.

    Alternates large-star and small-star rounds; every round is joins and
    partial aggregates on node keys, and its result is a written table. Nodes
    without a link are not in the result. Null ends and self links are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, files = None, max(1, -(-edges.count() // EDGES_A_FILE))
    for _ in range(max_rounds):
        # large star: every larger neighbour is hung on the smallest node next to u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and u itself are hung on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialise(small.coalesce(files), "edges")  # a round has at most twice as many edges as there were
        forget(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a star: u hangs on its root v; the root is its own component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
