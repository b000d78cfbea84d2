"""Queries of the general problems: p1 (times) and p4 (intervals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import intervals as iv
from memloom.operators import timestamps as ts
from memloom.session import cut
from memloom.sources.tables import table

AXES = {"valid": ("valid_time_start", "valid_time_end"), "evidence": ("evidence_time_start", "evidence_time_end")}


def written_times(spark: SparkSession, d: str) -> DataFrame:
    """Every written time of events and messages, with a row for each: (record_id, entity, moves, arrived, written, instant_us, how, status).

    entity is what keeps a zone history: the session of a message, the source app of an event's principal; the latter moves between zones.
    arrived is when the first delivery of the row was stored. Deliveries are one row before their text is read.
    """
    events = table(spark, d, "memory_events", "event_id", "event_time", "source_timezone", "principal_id", "source_app", "created_at")
    events = ts.read_times(_first(events, "created_at"), "event_time")
    entity = F.concat_ws(" ", F.lit("e"), "principal_id", "source_app")
    events = events.select(F.col("event_id").alias("record_id"), "written", F.col("source_timezone").alias("zone"), entity.alias("entity"), F.lit(True).alias("moves"), F.lit(None).cast("int").alias("sequence"), F.col("created_at").alias("arrived"))
    sessions = table(spark, d, "conversation_sessions", "session_id", "timezone", "locale")
    messages = _first(table(spark, d, "conversation_messages", "conversation_message_row_id", "session_id", "sequence", "created_at", "stored_at"), "stored_at")
    messages = ts.read_times(messages.join(sessions, "session_id", "left"), "created_at", "locale")
    entity = F.concat_ws(" ", F.lit("m"), "session_id")
    messages = messages.select(F.col("conversation_message_row_id").alias("record_id"), "written", F.col("timezone").alias("zone"), entity.alias("entity"), F.lit(False).alias("moves"), "sequence", F.col("stored_at").alias("arrived"))
    return ts.resolve(events.unionByName(messages), "zone").drop("zone")


def _first(df: DataFrame, arrived: str) -> DataFrame:
    """One row for each record: its deliveries differ in nothing but the arrival, of which the first counts."""
    return df.groupBy(*(c for c in df.columns if c != arrived)).agg(F.min(arrived).alias(arrived))


def estimated(spark: SparkSession, d: str, times: DataFrame) -> DataFrame:
    """times (see written_times) with the instants of the rows without a zone under the histories estimated for their entities.

    The order of a session's messages bounds them too: one that was stored late was written before the next message that names its instant.
    """
    # Rows without a zone, and of messages those that name their instant: read for the range, the stretches, the votes and the instants.
    times = cut(times.where("status = 'no_zone' OR (NOT moves AND sequence IS NOT NULL AND how IN ('number', 'text'))"))
    r = times.agg(F.min("written.local_us").alias("a"), F.max("written.local_us").alias("b")).first()
    zones = [table(spark, d, t, c).groupBy(F.col(c).alias("zone")).agg(F.count("*").alias("n")) for t, c in (("memory_events", "source_timezone"), ("conversation_sessions", "timezone"))]
    histories = cut(ts.zone_histories(spark, r.a or 0, r.b or 0, zones[0].unionByName(zones[1])))
    later = Window.partitionBy("entity", F.floor(F.col("sequence") / 4096)).orderBy("sequence").rowsBetween(1, Window.unboundedFollowing)
    following = F.when(~F.col("moves") & F.col("sequence").isNotNull(), F.timestamp_micros(F.first("instant_us", ignorenulls=True).over(later)))
    times = times.where("NOT moves").withColumn("seen", F.least("arrived", following)).withColumn("stretch", F.lit(0).cast("bigint")).unionByName(
        ts.change_points(times.where("moves AND status = 'no_zone'").withColumn("seen", F.col("arrived")), "entity", "seen", histories)
    )
    times = times.where("status = 'no_zone'").withColumn("entity", F.concat_ws(" ", "entity", "stretch"))
    return ts.estimate(times, "entity", "seen", histories).drop("seen", "stretch")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants named by the text itself or by the record's zone; estimates do not count here."""
    # A filter on the instants themselves would be moved before they are columns, and compute them once more.
    found = written_times(spark, d).select("record_id", F.explode(F.array("instant_us")).alias("instant_us"))
    return found.where("instant_us IS NOT NULL").dropDuplicates()


def p1_estimated(spark: SparkSession, d: str) -> DataFrame:
    """Local times without any zone, under the zone history estimated for their session, or for a stretch of time of their source."""
    return estimated(spark, d, written_times(spark, d)).where("how = 'estimated'").select("record_id", "zone_estimate", "instant_us")


def p1_status(spark: SparkSession, d: str) -> DataFrame:
    """How the instants were found, or why there is none."""
    return written_times(spark, d).groupBy("status", F.coalesce("how", F.lit("none")).alias("how")).agg(F.count("*").alias("n"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    cols = [c for pair in AXES.values() for c in pair]
    return iv.axis_intervals(table(spark, d, "timeline_facts", "entity_id", *cols), "entity_id", AXES)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(timeline(spark, d), ["entity_id", "axis"])


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return iv.periods(timeline(spark, d), ["entity_id", "axis"])


_P4_ROWS = """
WITH i AS (
  SELECT entity_id, 'valid' AS axis, epoch_us(valid_time_start) AS s, epoch_us(valid_time_end) AS e FROM timeline_facts
  UNION ALL
  SELECT entity_id, 'evidence', epoch_us(evidence_time_start), epoch_us(evidence_time_end) FROM timeline_facts
), r AS (
  SELECT entity_id, axis, s, e, max(e) OVER (PARTITION BY entity_id, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM i WHERE e > s
)"""

QUERIES = {"p1_found": p1_found, "p1_estimated": p1_estimated, "p1_status": p1_status, "p4_found": p4_found, "p4_periods": p4_periods}
SQL = {
    "p4_found": _P4_ROWS + " SELECT entity_id, axis, prev AS gap_start_us, s AS gap_end_us FROM r WHERE s > prev",
    "p4_periods": _P4_ROWS
    + """, g AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT entity_id, axis, min(s) AS start_us, max(e) AS end_us FROM g GROUP BY entity_id, axis, k""",
}
