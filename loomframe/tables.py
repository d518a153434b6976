"""Sessions and tables."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "loomframe", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with; on a cluster use the one that is there."""
    b = SparkSession.builder.appName(app).master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """Runs SQL whose tables are written as {name}; only those named are opened."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in template}
    return spark.sql(template, **named)


def plain(template: str) -> str:
    """The same SQL with plain table names."""
    for t in TABLES:
        template = template.replace(f"{{{t}}}", t)
    return template


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local master without it uses the warehouse. It is deleted when Python ends.

    A cluster without the setting is an error: a folder of one machine would lose data there.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/loomframe-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read again: cuts the lineage of iterations."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes a table of :func:`stored` that nothing reads any more, such as an iteration's round before the last; other tables are left alone."""
    path = getattr(df, "_stored", None)
    if path and (df.sparkSession, path) in _written:
        _written.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def release() -> None:
    """Deletes all scratch folders. Results that still read them must have been consumed."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; the folder is scratch space
            return


atexit.register(release)


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
