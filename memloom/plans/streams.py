"""Streaming queries: run over all of a table as a stream, and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.streaming import usage


def x01_session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Use of each user without a break of two hours, as a stream; sessions as the stream last had them."""
    events = usage.source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    x = usage.available_now(usage.sessions(events, "user_id", "ts", "2 hours", "1 day"), "complete")
    return x.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def x03_idempotent_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and application after redeliveries are dropped from the stream; the watermark keeps all keys of the table."""
    events = usage.source(spark, f"{d}/memory_events.parquet")
    x = usage.available_now(usage.once(events, "event_id", "created_at", "36500 days").select("event_id", "event_type", "source_app"))
    return x.groupBy("event_type", "source_app").agg(F.count("*").alias("n"))


def x01_debounced(spark: SparkSession, d: str) -> DataFrame:
    """Batches of each user's events that closed: after two hours without one, or eight hours after the first."""
    events = usage.source(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return usage.available_now(usage.debounced(events, "user_id", "ts", 7200, 28800))


QUERIES = {f.__name__: f for f in (x01_session_windows, x03_idempotent_events, x01_debounced)}
SQL = {
    "x01_session_windows": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events),
s AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(t) AS start_us, max(t) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "x03_idempotent_events": "SELECT event_type, source_app, count(DISTINCT event_id) AS n FROM memory_events GROUP BY 1, 2",
}
