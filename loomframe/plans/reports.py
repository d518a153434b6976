"""Reports over run logs: spread of repeated runs, scaling lines, bars and parameter sweeps, as tables that a plot needs.

A log line names an experiment and a time: ``id=<experiment> ... runtime_ms: <number>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import register
from ..tables import table


def times(lines: DataFrame) -> DataFrame:
    """(id, ms) of log lines (value); other lines are passed over."""
    out = lines.select(F.regexp_extract("value", r"id=(\S+)", 1).alias("id"), F.regexp_extract("value", r"runtime_ms: ([0-9.]+)", 1).try_cast("double").alias("ms"))
    return out.where("id <> '' and ms is not null")


def spread(runs: DataFrame) -> DataFrame:
    """(id, n, mean, sd, cv, median, mad, robust_cv) of (id, ms): sd of the sample, mad the median distance from the median, robust_cv 1.4826 mad / median."""
    middle = runs.groupBy("id").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.stddev_samp("ms").alias("sd"), F.median("ms").alias("median"))
    mad = runs.join(middle.select("id", "median"), "id").groupBy("id").agg(F.median(F.abs(F.col("ms") - F.col("median"))).alias("mad"))
    return middle.join(mad, "id").select("id", "n", "mean", "sd", (F.col("sd") / F.col("mean")).alias("cv"), "median", "mad", (1.4826 * F.col("mad") / F.col("median")).alias("robust_cv"))


def scaling(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, threads, ms) of rows (name, threads, ms): mean lines of the wanted names, blanks around these trimmed."""
    own = rows.withColumn("name", F.trim("name")).where(F.col("name").isin(*names))
    return own.groupBy("name", "threads").agg(F.avg("ms").alias("ms"))


def bars(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row for each alg with the mean ms of each name as a column."""
    return rows.groupBy("alg").pivot("name", names).agg(F.avg("ms"))


def sweep(rows: DataFrame) -> DataFrame:
    """(name, delta, ms, best): mean times by parameter, and whether it is the name's best (least time, then least parameter)."""
    mean = rows.groupBy("name", "delta").agg(F.avg("ms").alias("ms"))
    best = mean.groupBy("name").agg(F.min(F.struct("ms", "delta"))["delta"].alias("b"))
    return mean.join(best, "name").select("name", "delta", "ms", (F.col("delta") == F.col("b")).alias("best"))


def _runs(s, d) -> DataFrame:
    """Line items as run logs: the ship mode's experiment, the price as its time."""
    return table(s, d, "lineitem").select(F.concat(F.lit("id=e"), F.col("l_linenumber").cast("string"), F.lit(" threads=8 runtime_ms: "), F.round("l_extendedprice").cast("long").cast("string")).alias("value"))


def _rows(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    return li.select(F.concat(F.lit(" "), F.col("l_returnflag")).alias("name"), F.col("l_linestatus").alias("alg"), F.col("l_linenumber").alias("threads"), (F.col("l_partkey") % 5).alias("delta"), F.round("l_extendedprice").alias("ms"))


_MS = "(select 'e' || l_linenumber as id, cast(cast(round(l_extendedprice) as bigint) as double) as ms from lineitem)"
_SPREAD = f"with r as {_MS}, m as (select id, count(*) as n, avg(ms) as mean, stddev_samp(ms) as sd, median(ms) as median from r group by id), x as (select id, median(abs(ms - median)) as mad from r join m using (id) group by id) select id, n, round(mean, 4) as mean, round(sd, 4) as sd, round(sd / mean, 6) as cv, median, mad, round(1.4826e0 * mad / median, 6) as robust_cv from m join x using (id)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("cv", 6).alias("cv"), "median", "mad", F.round("robust_cv", 6).alias("robust_cv"))


register("run_variance", _SPREAD)(lambda s, d: _rounded(spread(times(_runs(s, d)))))
register("search_variance", _SPREAD.replace("'e' || l_linenumber", "'s' || l_returnflag"))(
    lambda s, d: _rounded(spread(times(table(s, d, "lineitem").select(F.concat(F.lit("search id=s"), F.col("l_returnflag"), F.lit(" runtime_ms: "), F.round("l_extendedprice").cast("long").cast("string")).alias("value")))))
)
register("scaling_lines", "select l_returnflag as name, l_linenumber as threads, round(avg(round(l_extendedprice)), 4) as ms from lineitem where l_returnflag in ('A', 'R') group by 1, 2")(lambda s, d: scaling(_rows(s, d), ["A", "R"]).withColumn("ms", F.round("ms", 4)))
register("bar_summary", "select l_linestatus as alg, round(avg(round(l_extendedprice)) filter (l_returnflag = 'A'), 4) as a, round(avg(round(l_extendedprice)) filter (l_returnflag = 'N'), 4) as n from lineitem group by 1")(
    lambda s, d: bars(_rows(s, d).withColumn("name", F.trim("name")), ["A", "N"]).select("alg", F.round("A", 4).alias("a"), F.round("N", 4).alias("n"))
)
register("delta_sweep", "with m as (select l_returnflag as name, l_partkey % 5 as delta, avg(round(l_extendedprice)) as ms from lineitem group by 1, 2) select name, delta, round(ms, 4) as ms, row_number() over (partition by name order by ms, delta) = 1 as best from m")(
    lambda s, d: sweep(_rows(s, d).withColumn("name", F.trim("name"))).withColumn("ms", F.round("ms", 4))
)
