"""Event-time operators for batches and streams alike: the same function takes either kind of DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..tables import table

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def events_at(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events with a time zone time and a watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by windows that do not overlap."""
    w = events_at(events).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    w = events_at(events).groupBy(F.window("at", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events with gaps below ``gap``."""
    w = events_at(events).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(events: DataFrame) -> DataFrame:
    """Events without repeats of an id."""
    return events_at(events).dropDuplicates(["event_id"])


register("stream_tumbling", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")(lambda s, d: tumbling(table(s, d, "events")))
register("stream_sliding", "select time_bucket(interval 1 hour, ts) - h * interval 1 hour as start, count(*) as n from events, range(2) t(h) group by 1")(lambda s, d: sliding(table(s, d, "events")))
register("stream_sessions", "select user_id, min(ts) as start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)) group by user_id, g")(lambda s, d: sessions(table(s, d, "events")))
register("stream_dedup", "select count(distinct event_id) as n from events")(lambda s, d: first_seen(table(s, d, "events")).agg(F.count("*").alias("n")))
register("event_props", """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
