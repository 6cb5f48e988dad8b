"""Queries of event windows, and of the append log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..streaming import logs
from .base import table


def event_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return logs.tumbling(table(spark, sf, "events"), "ts", "1 day", "event_type")


def event_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sliding(table(spark, sf, "events"), "ts", "2 days", "1 day")


def event_session(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sessions(table(spark, sf, "events"), "ts", "2 days", "user_id").select("user_id", "start", "n")


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The events read as a stream, one row per id, drained to Parquet in the shared folder and read back."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf, "events")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    stream = logs.first_seen(logs.log_stream(spark, f"{sf}/events.parquet*", ddl), ["event_id"], "ts", "400 days")
    logs.drained(stream.select("event_id", "user_id", "event_type"), f"{at}/sink", f"{at}/state")
    return spark.read.parquet(f"{at}/sink").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def stream_compact(spark: SparkSession, sf: str) -> DataFrame:
    """A log that grows between two runs, compacted by a stream that goes on where it was."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").where("event_type <> 'error'").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{at}/log")
        stream = logs.log_stream(spark, f"{at}/log", "user_id BIGINT, event_id BIGINT, event_type STRING, ts TIMESTAMP")
        logs.upserted(logs.latest(stream, "user_id", "ts", "event_id"), f"{at}/sink", f"{at}/state")
    return logs.current(spark, f"{at}/sink", ["user_id"]).select("user_id", "event_id", "event_type")


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows of a stream with a watermark, each as the last batch that changed it left it."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf, "events")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    stream = logs.log_stream(spark, f"{sf}/events.parquet*", ddl).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "400 days")
    logs.upserted(logs.tumbling(stream, "ts", "1 day", "event_type"), f"{at}/sink", f"{at}/state")
    return logs.current(spark, f"{at}/sink", ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {
    "event_tumbling": (event_tumbling, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "event_sliding": (event_sliding, "SELECT start, count(*) AS n FROM (SELECT date_trunc('day', ts) AS start FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY FROM events) GROUP BY 1"),
    "event_session": (event_session, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"),
    "stream_compact": (stream_compact, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1"),
    "stream_tumbling": (stream_tumbling, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_dedupe": (stream_dedupe, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
}
