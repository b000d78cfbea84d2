"""Temporal, version, lineage, graph and usage queries over events, facts, timelines, relations and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import temporal as tm
from memloom.operators import intervals as iv
from memloom.operators.overlap import overlap_join
from memloom.operators.slices import running_sum
from memloom.plans.problems import AXES, timeline
from memloom.sources.tables import table

FROM, TO = "2024-01-01 00:00:00", "2026-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"
TOLERANCE_US = 2 * 3_600_000_000
BUCKET_US = 30 * 86_400_000_000
ZONE = "Asia/Shanghai"


def _range():
    return F.lit(FROM).cast("timestamp"), F.lit(TO).cast("timestamp")


def f06_interval_match(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "timeline_facts", "aggregation_id", *[c for p in AXES.values() for c in p])
    hits = [F.when(tm.intersects(F.col(s), F.col(e), *_range()), F.lit(a)) for a, (s, e) in AXES.items()]
    return x.select("aggregation_id", F.explode(F.array_compact(F.array(*hits))).alias("axis"))


def f08_axis_fallback(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each basis keeps or drops, by reason."""
    x = table(spark, d, "timeline_facts", *[c for p in AXES.values() for c in p])
    ev, va = [tuple(F.col(c) for c in AXES[a]) for a in ("evidence", "valid")]
    per = [F.struct(F.lit(b).alias("basis"), F.coalesce(tm.drop_reason(b, ev, va, *_range()), F.lit("kept")).alias("reason")) for b in ("evidence", "valid", "auto")]
    return x.select(F.explode(F.array(*per)).alias("r")).groupBy("r.basis", "r.reason").agg(F.count("*").alias("n"))


def f09_evidence_envelope(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "timeline_facts", "aggregation_id", *AXES["evidence"])
    return x.where(tm.envelope_intersects(F.col("evidence_time_start"), F.col("evidence_time_end"), *_range())).select("aggregation_id")


def f11_data_lake_search(spark: SparkSession, d: str) -> DataFrame:
    """Events by a path into their properties, a type and a part of the user's id."""
    x = table(spark, d, "events", "event_id", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return x.where((F.col("event_type") == "purchase") & (k >= 50) & (F.instr(F.col("user_id").cast("string"), "7") > 0)).select("event_id", "user_id", k.alias("k"))


def f12_inventory(spark: SparkSession, d: str) -> DataFrame:
    """One inventory over five kinds of objects: (kind, owner, n, newest)."""
    kinds = {
        "event": ("memory_events", "event_id", "principal_id", "created_at"), "session": ("conversation_sessions", "session_id", "principal_id", "committed_at"),
        "fact": ("fact_items", "fact_id", "principal_id", "observed_at"), "relation": ("fusion_relations", "relation_id", "task_id", "created_at"),
        "timeline": ("timeline_facts", "aggregation_id", "entity_id", "evidence_time_start"),
    }
    parts = [table(spark, d, t, i, o, at).select(F.lit(k).alias("kind"), F.col(o).alias("owner"), F.col(i).alias("id"), F.unix_micros(F.col(at)).alias("at")) for k, (t, i, o, at) in kinds.items()]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.groupBy("kind", "owner", "id").agg(F.max("at").alias("at")).groupBy("kind", "owner").agg(F.count("*").alias("n"), F.max("at").alias("newest_us"))


def a05_temporal_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: the valid envelope, the weakest confidence, and the basis where it is the same throughout."""
    rank = F.when(F.col("valid_time_confidence") == "low", 0).when(F.col("valid_time_confidence") == "medium", 1).when(F.col("valid_time_confidence") == "high", 2)
    x = table(spark, d, "timeline_facts", "entity_id", "valid_time_start", "valid_time_end", "valid_time_basis", "valid_time_confidence").where("valid_time_start IS NOT NULL")
    same = F.when(F.min("valid_time_basis") == F.max("valid_time_basis"), F.min("valid_time_basis"))
    return x.groupBy("entity_id").agg(
        F.min(F.unix_micros("valid_time_start")).alias("start_us"), F.max(F.unix_micros(F.coalesce("valid_time_end", "valid_time_start"))).alias("end_us"), F.min(rank).alias("confidence"), same.alias("basis"), F.count("*").alias("n")
    )


def w01_fusion_windows(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and axis: intervals at most two hours apart as one window, widened by two hours on either side."""
    x = timeline(spark, d).select("entity_id", "axis", "start_us", (F.col("end_us") + TOLERANCE_US).alias("end_us"))
    p = iv.periods(x, ["entity_id", "axis"])
    return p.select("entity_id", "axis", (F.col("start_us") - TOLERANCE_US).alias("start_us"), "end_us")


def j07_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Every timeline row whose number is divisible by 100 with all rows of its entity whose valid times overlap its own."""
    x = table(spark, d, "timeline_facts", "entity_id", "aggregation_id", "valid_time_start", "valid_time_end")
    x = x.select("entity_id", "aggregation_id", F.unix_micros("valid_time_start").alias("start_us"), F.unix_micros("valid_time_end").alias("end_us")).where("end_us > start_us")
    probes = x.where(F.regexp_extract("aggregation_id", r"(\d+)$", 1).try_cast("long") % 100 == 0)
    y = overlap_join(probes, x, ["entity_id"], BUCKET_US).where("aggregation_id <> r_aggregation_id")
    shared = F.least("end_us", "r_end_us") - F.greatest("start_us", "r_start_us")
    return y.select("aggregation_id", F.col("r_aggregation_id").alias("other_id"), shared.alias("shared_us"))


def d03_local_days(spark: SparkSession, d: str) -> DataFrame:
    """Events by local day, ISO week and cutoff of a zone."""
    x = table(spark, d, "memory_events", "event_id", "created_at").groupBy("event_id").agg(F.min("created_at").alias("at"))
    day, local = tm.local_day_start(F.col("at"), ZONE), F.from_utc_timestamp("at", ZONE)
    x = x.select(F.unix_micros(day).alias("day_us"), F.dayofweek(local).alias("weekday"), F.weekofyear(local).alias("week"), F.unix_micros(tm.last_cutoff(F.col("at"), ZONE)).alias("cutoff_us"))
    return x.groupBy("day_us", "weekday", "week", "cutoff_us").agg(F.count("*").alias("n"))


def j12_latest_message(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversation_messages", "session_id", "message_id", "revision", "operation", "status", "stored_at")
    return x.groupBy("session_id", "message_id").agg(F.max_by(F.struct("revision", "operation", "status"), F.struct("revision", "stored_at")).alias("m")).select("session_id", "message_id", "m.*")


def j15_as_of_version(spark: SparkSession, d: str) -> DataFrame:
    """Each message as its session's commit saw it: the highest revision stored by then."""
    s = table(spark, d, "conversation_sessions", "session_id", "committed_at")
    m = table(spark, d, "conversation_messages", "session_id", "message_id", "revision", "stored_at")
    x = m.join(s, "session_id").where("stored_at <= committed_at")
    return x.groupBy("session_id", "message_id").agg(F.max("revision").alias("revision"))


def w05_version_chain(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of messages with the one before each; the deliveries of a revision count once."""
    x = table(spark, d, "conversation_messages", "session_id", "message_id", "revision", "operation").dropDuplicates()
    w = Window.partitionBy("session_id", "message_id").orderBy("revision")
    return x.withColumn("previous", F.lag("revision").over(w)).where("revision > 1").select("session_id", "message_id", "revision", "operation", "previous")


def x05_evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a session in groups that end with a completed assistant message: (session_id, group_no, first, last, messages)."""
    x = table(spark, d, "conversation_messages", "session_id", "message_id", "sequence", "revision", "role", "status", "operation", "stored_at")
    x = x.groupBy("session_id", "message_id").agg(F.max_by(F.struct("sequence", "role", "status", "operation"), F.struct("revision", "stored_at")).alias("m")).select("session_id", "message_id", "m.*")
    x = x.where("sequence IS NOT NULL AND operation <> 'delete'").withColumn("slice", F.floor(F.col("sequence") / 4096))
    ends = ((F.lower(F.trim("role")) == "assistant") & (F.col("status") == "completed")).cast("int")
    x = running_sum(x.withColumn("_at", F.struct("sequence", "message_id")), ["session_id"], F.coalesce(ends, F.lit(0)), "_at", "group_no")
    return x.groupBy("session_id", "group_no").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("messages"))


def g04_retraction(spark: SparkSession, d: str) -> DataFrame:
    """Facts of sessions with a message that was deleted or replaced last become superseded, one version up."""
    gone = j12_latest_message(spark, d).where("operation IN ('delete', 'replace')").select("session_id").dropDuplicates()
    f = table(spark, d, "fact_items", "fact_id", "session_id", "version", "status").dropDuplicates()
    return f.where("status = 'active'").join(gone, "session_id", "left_semi").select("fact_id", (F.col("version") + 1).alias("version"), F.lit("superseded").alias("status"))


def g05_negation_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Facts of which one denies the other: the same principal and type, and equal claims once the first negation of one is taken out."""
    f = table(spark, d, "fact_items", "fact_id", "principal_id", "fact_type", "normalized_claim").dropDuplicates().where("normalized_claim IS NOT NULL")
    without = F.trim(F.regexp_replace("normalized_claim", r"(?s)^(.*?)\b(not|never|no)\b ?", "$1"))
    keys = ["principal_id", "fact_type", "base"]
    denials = f.where(F.col("normalized_claim").rlike(r"\b(not|never|no)\b")).select("fact_id", *keys[:2], without.alias("base"), F.lit(1).alias("denies"))
    x = denials.unionByName(f.select("fact_id", *keys[:2], F.trim("normalized_claim").alias("base"), F.lit(0).alias("denies"))).where("length(base) >= 4")
    both = x.groupBy(*keys).agg(F.min("denies").alias("n"), F.max("denies").alias("y")).where("y = 1 AND n = 0").select(*keys)
    return x.join(both, keys, "left_semi").select("fact_id").dropDuplicates()


def g07_all_sources_gone(spark: SparkSession, d: str) -> DataFrame:
    """Relations all of whose known facts are superseded or rejected in their highest version."""
    f = table(spark, d, "fact_items", "fact_id", "version", "status").groupBy("fact_id").agg(F.max_by("status", F.struct("version", "status")).alias("status"))
    r = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids").select("relation_id", F.explode(F.array_distinct("source_fact_ids")).alias("fact_id"))
    x = r.join(f, "fact_id").groupBy("relation_id").agg(F.bool_and(F.col("status").isin("superseded", "rejected")).alias("gone"), F.count("*").alias("facts"))
    return x.where("gone").select("relation_id", "facts")


def j05_scope_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Entities reached from each session: session -> facts -> timeline, counted once."""
    f = table(spark, d, "fact_items", "session_id", "fact_id").where("session_id IS NOT NULL").dropDuplicates()
    t = table(spark, d, "timeline_facts", "fact_id", "entity_id").dropDuplicates()
    return f.join(t, "fact_id").groupBy("session_id").agg(F.count_distinct("fact_id").alias("facts"), F.count_distinct("entity_id").alias("entities"))


def j18_lineage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per relation: named, known and distinct sessions of its facts; relations without facts stay with zeros."""
    r = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids").select("relation_id", F.explode_outer(F.array_distinct("source_fact_ids")).alias("fact_id"))
    f = table(spark, d, "fact_items", "fact_id", "session_id").groupBy("fact_id").agg(F.min("session_id").alias("session_id"), F.lit(1).alias("known"))
    x = r.join(f, "fact_id", "left")
    return x.groupBy("relation_id").agg(F.count("fact_id").alias("named"), F.count("known").alias("known"), F.count_distinct("session_id").alias("sessions"))


def j19_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What would go with the sessions of one application: session -> message, fact -> timeline, relation; counts per layer."""
    s = table(spark, d, "conversation_sessions", "session_id", "source_app").where("source_app = 'desk-agent'").select("session_id")
    m = table(spark, d, "conversation_messages", "session_id", "conversation_message_row_id").join(s, "session_id", "left_semi").select("conversation_message_row_id").dropDuplicates()
    f = table(spark, d, "fact_items", "session_id", "fact_id").join(s, "session_id", "left_semi").select("fact_id").dropDuplicates()
    t = table(spark, d, "timeline_facts", "fact_id", "aggregation_id").join(f, "fact_id", "left_semi").select("aggregation_id")
    r = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids").select("relation_id", F.explode("source_fact_ids").alias("fact_id")).join(f, "fact_id", "left_semi").select("relation_id").dropDuplicates()
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("layer"), "n") for k, x in (("session", s), ("message", m), ("fact", f), ("timeline", t), ("relation", r))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# What a relation type and a confidence count for in one-hop expansion.
RELATION = {"same_event": 1.0, "updates": 0.9, "supplements": 0.7, "supports": 0.7, "conflicts": 0.6}
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}


def j09_graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """One hop from every fact whose number is divisible by 100: the best 20 other facts of its relations, by type and confidence."""
    weight = F.create_map(*[F.lit(v) for kv in RELATION.items() for v in kv])[F.lower(F.trim("type"))]
    factor = F.coalesce(F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv])[F.col("confidence_level")], F.lit(0.7))
    x = table(spark, d, "fusion_relations", "relation_id", "type", "source_fact_ids", "confidence_level").withColumn("score", F.round(weight * factor * 0.5, 6)).where("score IS NOT NULL")
    ends = x.select("relation_id", "score", F.explode(F.array_distinct("source_fact_ids")).alias("fact_id"))
    known = table(spark, d, "fact_items", "fact_id").dropDuplicates()
    ends = ends.join(known, "fact_id", "left_semi")
    seeds = ends.where(F.regexp_extract("fact_id", r"(\d+)$", 1).try_cast("long") % 100 == 0).select("relation_id", F.col("fact_id").alias("seed_id"))
    best = seeds.join(ends, "relation_id").where("seed_id <> fact_id").groupBy("seed_id", "fact_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("seed_id").orderBy(F.desc("score"), "fact_id")
    return best.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


def j10_infer_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between facts that share evidence, as stars around the smallest fact: the same claim, or the same session and type."""
    f = table(spark, d, "fact_items", "fact_id", "session_id", "fact_type", "normalized_claim").dropDuplicates()
    part = F.when(F.col("session_id").isNotNull() & F.col("fact_type").isNotNull(), F.concat_ws("|", "session_id", "fact_type"))
    keys = [F.struct(F.lit("is_same_as").alias("type"), F.when(F.trim("normalized_claim") != "", F.sha2("normalized_claim", 256)).alias("key")), F.struct(F.lit("part_of").alias("type"), part.alias("key"))]
    x = f.select("fact_id", F.explode(F.array(*keys)).alias("k")).select("fact_id", "k.*").where("key IS NOT NULL").dropDuplicates()
    hub = x.groupBy("type", "key").agg(F.min("fact_id").alias("from_id"))
    return x.join(hub, ["type", "key"]).where("fact_id <> from_id").select("from_id", F.col("fact_id").alias("to_id"), "type")


def j11_known_edges(spark: SparkSession, d: str) -> DataFrame:
    """Two-ended relations both of whose facts exist."""
    r = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids").where("size(source_fact_ids) = 2").select("relation_id", F.col("source_fact_ids")[0].alias("a"), F.col("source_fact_ids")[1].alias("b"))
    known = table(spark, d, "fact_items", "fact_id").dropDuplicates()
    return r.join(known.select(F.col("fact_id").alias("a")), "a", "left_semi").join(known.select(F.col("fact_id").alias("b")), "b", "left_semi").select("relation_id", "a", "b")


def l05_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of 50 facts after a cursor in the order (status, fact_id), and whether there is more."""
    f = table(spark, d, "fact_items", "fact_id", "status").dropDuplicates()
    after = (F.col("status") > "active") | ((F.col("status") == "active") & (F.col("fact_id") > "fact_0000000500"))
    page = f.where(after).orderBy("status", "fact_id").limit(51)
    x = page.withColumn("n", F.row_number().over(Window.orderBy("status", "fact_id")))  # 51 rows
    return x.withColumn("has_more", F.max("n").over(Window.partitionBy()) > 50).where("n <= 50").select("fact_id", "status", "has_more")


def _usage(spark, d):
    """Events as uses of memories: what happened to which owner, in which session and task."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    kind = F.create_map(*[F.lit(v) for kv in (("view", "search_hit"), ("click", "context_pack_selected"), ("purchase", "agent_cited"), ("signup", "like"), ("error", "dislike")) for v in kv])
    return e.select(F.col("user_id").alias("owner_id"), kind[F.col("event_type")].alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("event_id") % 50).alias("session"), (F.col("event_id") % 20).alias("task"))


def a01_reuse_signals(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each owner in 30 days: counts, distinct sessions and tasks, and their value, which halves in about ten days."""
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.col("at_us")) / 86_400_000_000
    weight = F.create_map(*[F.lit(v) for kv in (("search_hit", 0.55), ("context_pack_selected", 1.25), ("agent_cited", 1.75), ("like", 1.5), ("dislike", -1.5)) for v in kv])[F.col("kind")]
    x = _usage(spark, d).withColumn("age", age).where("age <= 30")
    value = F.sum(F.coalesce(weight, F.lit(0.0)) * F.exp(-F.greatest(F.col("age"), F.lit(0.0)) / 14))
    g = x.groupBy("owner_id").agg(
        F.count_distinct(F.when(F.col("age") <= 7, F.col("session"))).alias("sessions_7d"), F.count_distinct("session").alias("sessions_30d"), F.count_distinct("task").alias("tasks_30d"),
        F.count_if(F.col("kind") == "search_hit").alias("search_hits"), F.count_if(F.col("kind") == "context_pack_selected").alias("packs"), F.count_if(F.col("kind") == "agent_cited").alias("citations"),
        F.count_if(F.col("kind") == "like").alias("likes"), F.count_if(F.col("kind") == "dislike").alias("dislikes"), value.alias("_v"),
    )
    total = F.col("_v") + F.least(F.lit(2.0), F.col("sessions_30d") * 0.35) + F.least(F.lit(2.0), F.col("tasks_30d") * 0.5)
    return g.withColumn("reuse_value", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 2)).drop("_v")


def u11_usage_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One use for each owner, hour and kind: the first; and how many there were."""
    x = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return x.groupBy("user_id", hour.alias("hour"), "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n")).where("n > 1")


def s03_event_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent event write: the last delivery of each key, with the number of deliveries."""
    x = table(spark, d, "memory_events", "event_id", "event_type", "source_app", "created_at")
    return x.groupBy("event_id").agg(F.max_by(F.struct("event_type", "source_app"), "created_at").alias("e"), F.count("*").alias("deliveries")).where("deliveries > 1").select("event_id", "e.*", "deliveries")


def a22_session_span(spark: SparkSession, d: str) -> DataFrame:
    """Per session: first and last storage, and the weakest confidence of its facts."""
    m = table(spark, d, "conversation_messages", "session_id", "stored_at").groupBy("session_id").agg(F.min(F.unix_micros("stored_at")).alias("first_us"), F.max(F.unix_micros("stored_at")).alias("last_us"))
    rank = F.when(F.col("confidence_level") == "low", 0).when(F.col("confidence_level") == "medium", 1).when(F.col("confidence_level") == "high", 2)
    f = table(spark, d, "fact_items", "session_id", "confidence_level").groupBy("session_id").agg(F.min(rank).alias("confidence"))
    return m.join(f, "session_id", "left")


_W = f"TIMESTAMPTZ '{FROM}+00' AS f, TIMESTAMPTZ '{TO}+00' AS t"


def _meets(s: str, e: str) -> str:
    return f"coalesce(CASE WHEN {e} IS NULL OR {e} = {s} THEN {s} >= f AND {s} < t ELSE {s} < t AND {e} > f END, false)"


_V, _E = _meets("valid_time_start", "valid_time_end"), _meets("evidence_time_start", "evidence_time_end")
_LAST = "(SELECT * FROM conversation_messages QUALIFY row_number() OVER (PARTITION BY session_id, message_id ORDER BY revision DESC, stored_at DESC) = 1)"
_NUM = "TRY_CAST(regexp_extract({}, '(\\d+)$', 1) AS BIGINT)"
_RANK = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"

QUERIES = {
    f.__name__: f
    for f in (
        f06_interval_match, f08_axis_fallback, f09_evidence_envelope, f11_data_lake_search, f12_inventory, a05_temporal_envelope, w01_fusion_windows, j07_interval_overlap, d03_local_days, j12_latest_message, j15_as_of_version,
        w05_version_chain, x05_evidence_groups, g04_retraction, g05_negation_conflict, g07_all_sources_gone, j05_scope_lineage, j18_lineage_counts, j19_cascade, j09_graph_neighbors, j10_infer_relations, j11_known_edges,
        l05_keyset_page, a01_reuse_signals, u11_usage_dedup, s03_event_upsert, a22_session_span,
    )
}
SQL = {
    "f06_interval_match": f"SELECT aggregation_id, 'valid' AS axis FROM timeline_facts, (SELECT {_W}) WHERE {_V} UNION ALL SELECT aggregation_id, 'evidence' FROM timeline_facts, (SELECT {_W}) WHERE {_E}",
    "f08_axis_fallback": f"""WITH x AS (SELECT *, {_V} AS v, {_E} AS e FROM timeline_facts, (SELECT {_W})), r AS (
  SELECT 'evidence' AS basis, CASE WHEN evidence_time_start IS NULL THEN 'temporal_metadata_missing' WHEN e OR (valid_time_start IS NOT NULL AND v) THEN 'kept' ELSE 'outside_evidence_time_range' END AS reason FROM x
  UNION ALL SELECT b, CASE WHEN valid_time_start IS NOT NULL AND NOT v THEN 'outside_valid_time_range' ELSE 'kept' END FROM x, (VALUES ('valid'), ('auto')) AS b(b))
SELECT basis, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "f09_evidence_envelope": f"""SELECT aggregation_id FROM timeline_facts, (SELECT {_W})
WHERE coalesce(evidence_time_end, evidence_time_start) >= f AND coalesce(evidence_time_start, evidence_time_end) < t""",
    "f11_data_lake_search": "SELECT event_id, user_id, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'purchase' AND (props->>'$.k')::INT >= 50 AND contains(user_id::VARCHAR, '7')",
    "f12_inventory": """WITH x AS (SELECT 'event' AS kind, principal_id AS owner, event_id AS id, created_at AS ts_ FROM memory_events UNION ALL SELECT 'session', principal_id, session_id, committed_at FROM conversation_sessions
 UNION ALL SELECT 'fact', principal_id, fact_id, observed_at FROM fact_items UNION ALL SELECT 'relation', task_id, relation_id, created_at FROM fusion_relations UNION ALL SELECT 'timeline', entity_id, aggregation_id, evidence_time_start FROM timeline_facts)
SELECT kind, owner, count(DISTINCT id) AS n, epoch_us(max(ts_)) AS newest_us FROM x GROUP BY 1, 2""",
    "a05_temporal_envelope": f"""SELECT entity_id, epoch_us(min(valid_time_start)) AS start_us, epoch_us(max(coalesce(valid_time_end, valid_time_start))) AS end_us, min({_RANK.format("valid_time_confidence")}) AS confidence,
 CASE WHEN min(valid_time_basis) = max(valid_time_basis) THEN min(valid_time_basis) END AS basis, count(*) AS n FROM timeline_facts WHERE valid_time_start IS NOT NULL GROUP BY 1""",
    "w01_fusion_windows": f"""WITH i AS (SELECT entity_id, 'valid' AS axis, epoch_us(valid_time_start) AS s, epoch_us(valid_time_end) AS e FROM timeline_facts UNION ALL SELECT entity_id, 'evidence', epoch_us(evidence_time_start), epoch_us(evidence_time_end) FROM timeline_facts),
r AS (SELECT *, max(e) OVER (PARTITION BY entity_id, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i WHERE e > s),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + {TOLERANCE_US} THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT entity_id, axis, min(s) - {TOLERANCE_US} AS start_us, max(e) + {TOLERANCE_US} AS end_us FROM g GROUP BY entity_id, axis, k""",
    "j07_interval_overlap": f"""WITH x AS (SELECT entity_id, aggregation_id AS id, epoch_us(valid_time_start) AS s, epoch_us(valid_time_end) AS e FROM timeline_facts WHERE valid_time_end > valid_time_start)
SELECT a.id AS aggregation_id, b.id AS other_id, least(a.e, b.e) - greatest(a.s, b.s) AS shared_us FROM x a JOIN x b ON a.entity_id = b.entity_id AND a.s < b.e AND b.s < a.e AND a.id <> b.id WHERE {_NUM.format("a.id")} % 100 = 0""",
    "d03_local_days": """WITH x AS (SELECT event_id, min(created_at) AT TIME ZONE 'Asia/Shanghai' AS l FROM memory_events GROUP BY 1)
SELECT epoch_us(date_trunc('day', l) AT TIME ZONE 'Asia/Shanghai') AS day_us, (dayofweek(l) + 1)::INT AS weekday, weekofyear(l)::INT AS week,
 epoch_us((date_trunc('day', l - INTERVAL 23 HOUR) + INTERVAL 23 HOUR) AT TIME ZONE 'Asia/Shanghai') AS cutoff_us, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""",
    "j12_latest_message": f"SELECT session_id, message_id, revision, operation, status FROM {_LAST}",
    "j15_as_of_version": "SELECT session_id, message_id, max(revision) AS revision FROM conversation_messages JOIN conversation_sessions USING (session_id) WHERE stored_at <= committed_at GROUP BY 1, 2",
    "w05_version_chain": """WITH x AS (SELECT DISTINCT session_id, message_id, revision, operation FROM conversation_messages)
SELECT * FROM (SELECT *, lag(revision) OVER (PARTITION BY session_id, message_id ORDER BY revision) AS previous FROM x) WHERE revision > 1""",
    "x05_evidence_groups": f"""WITH g AS (SELECT session_id, sequence, coalesce(sum((coalesce(lower(trim(role, ' ')) = 'assistant' AND status = 'completed', false))::INT) OVER (PARTITION BY session_id ORDER BY sequence, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_no
 FROM {_LAST} WHERE sequence IS NOT NULL AND operation <> 'delete') SELECT session_id, group_no, min(sequence) AS first, max(sequence) AS last, count(*) AS messages FROM g GROUP BY 1, 2""",
    "g04_retraction": f"""SELECT fact_id, version + 1 AS version, 'superseded' AS status FROM (SELECT DISTINCT fact_id, session_id, version, status FROM fact_items)
WHERE status = 'active' AND session_id IN (SELECT session_id FROM {_LAST} WHERE operation IN ('delete', 'replace'))""",
    "g05_negation_conflict": r"""WITH f AS (SELECT DISTINCT fact_id, principal_id, fact_type, normalized_claim AS c FROM fact_items WHERE normalized_claim IS NOT NULL),
x AS (SELECT fact_id, principal_id, fact_type, trim(regexp_replace(c, '\b(not|never|no)\b ?', '')) AS base, 1 AS denies FROM f WHERE regexp_matches(c, '\b(not|never|no)\b') UNION ALL SELECT fact_id, principal_id, fact_type, trim(c), 0 FROM f),
b AS (SELECT principal_id, fact_type, base FROM x WHERE length(base) >= 4 GROUP BY ALL HAVING min(denies) = 0 AND max(denies) = 1) SELECT DISTINCT fact_id FROM x JOIN b USING (principal_id, fact_type, base)""",
    "g07_all_sources_gone": """WITH f AS (SELECT fact_id, arg_max(status, (version, status)) AS status FROM fact_items GROUP BY 1), r AS (SELECT relation_id, unnest(list_distinct(source_fact_ids)) AS fact_id FROM fusion_relations)
SELECT relation_id, count(*) AS facts FROM r JOIN f USING (fact_id) GROUP BY 1 HAVING bool_and(status IN ('superseded', 'rejected'))""",
    "j05_scope_lineage": "SELECT session_id, count(DISTINCT f.fact_id) AS facts, count(DISTINCT entity_id) AS entities FROM fact_items f JOIN timeline_facts t USING (fact_id) WHERE session_id IS NOT NULL GROUP BY 1",
    "j18_lineage_counts": """WITH r AS (SELECT relation_id, unnest(list_distinct(source_fact_ids)) AS fact_id FROM fusion_relations), f AS (SELECT fact_id, min(session_id) AS session_id FROM fact_items GROUP BY 1)
SELECT x.relation_id, count(r.fact_id) AS named, count(f.fact_id) AS known, count(DISTINCT session_id) AS sessions FROM (SELECT relation_id FROM fusion_relations) x LEFT JOIN r USING (relation_id) LEFT JOIN f USING (fact_id) GROUP BY 1""",
    "j19_cascade": """WITH s AS (SELECT session_id FROM conversation_sessions WHERE source_app = 'desk-agent'), f AS (SELECT DISTINCT fact_id FROM fact_items WHERE session_id IN (FROM s))
SELECT 'session' AS layer, count(*) AS n FROM s UNION ALL SELECT 'message', count(DISTINCT conversation_message_row_id) FROM conversation_messages WHERE session_id IN (FROM s) UNION ALL SELECT 'fact', count(*) FROM f
UNION ALL SELECT 'timeline', count(*) FROM timeline_facts WHERE fact_id IN (FROM f) UNION ALL SELECT 'relation', count(DISTINCT relation_id) FROM (SELECT relation_id, unnest(source_fact_ids) AS x FROM fusion_relations) WHERE x IN (FROM f)""",
    "j09_graph_neighbors": f"""WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in RELATION.items())}) t(ty, wt)), c AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in CONFIDENCE.items())}) t(cl, fa)),
e AS (SELECT relation_id, round(wt * coalesce(fa, 0.7::DOUBLE) * 0.5::DOUBLE, 6) AS score, unnest(list_distinct(source_fact_ids)) AS fact_id FROM fusion_relations JOIN w ON ty = lower(trim(type)) LEFT JOIN c ON cl = confidence_level),
k AS (SELECT * FROM e WHERE fact_id IN (SELECT fact_id FROM fact_items)), b AS (SELECT s.fact_id AS seed_id, o.fact_id, max(o.score) AS score FROM k s JOIN k o USING (relation_id) WHERE {_NUM.format("s.fact_id")} % 100 = 0 AND s.fact_id <> o.fact_id GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, fact_id)::INT AS rank FROM b QUALIFY rank <= 20""",
    "j10_infer_relations": """WITH f AS (SELECT DISTINCT fact_id, session_id, fact_type, normalized_claim FROM fact_items), x AS (SELECT DISTINCT fact_id, 'is_same_as' AS type, normalized_claim AS key FROM f WHERE trim(normalized_claim) <> '' UNION SELECT fact_id, 'part_of', session_id || '|' || fact_type FROM f WHERE session_id IS NOT NULL AND fact_type IS NOT NULL)
SELECT * FROM (SELECT min(fact_id) OVER (PARTITION BY type, key) AS from_id, fact_id AS to_id, type FROM x) WHERE from_id <> to_id""",
    "j11_known_edges": "SELECT relation_id, source_fact_ids[1] AS a, source_fact_ids[2] AS b FROM fusion_relations WHERE len(source_fact_ids) = 2 AND source_fact_ids[1] IN (SELECT fact_id FROM fact_items) AND source_fact_ids[2] IN (SELECT fact_id FROM fact_items)",
    "l05_keyset_page": """WITH p AS (SELECT DISTINCT fact_id, status FROM fact_items WHERE (status, fact_id) > ('active', 'fact_0000000500') ORDER BY status, fact_id LIMIT 51)
SELECT fact_id, status, (SELECT count(*) FROM p) > 50 AS has_more FROM p ORDER BY status, fact_id LIMIT 50""",
    "a01_reuse_signals": f"""WITH x AS (SELECT user_id AS owner_id, event_type AS t, event_id % 50 AS s, event_id % 20 AS k, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000 AS age FROM events)
SELECT owner_id, count(DISTINCT CASE WHEN age <= 7 THEN s END) AS sessions_7d, count(DISTINCT s) AS sessions_30d, count(DISTINCT k) AS tasks_30d, count(*) FILTER (WHERE t = 'view') AS search_hits, count(*) FILTER (WHERE t = 'click') AS packs,
 count(*) FILTER (WHERE t = 'purchase') AS citations, count(*) FILTER (WHERE t = 'signup') AS likes, count(*) FILTER (WHERE t = 'error') AS dislikes,
 round(greatest(0::DOUBLE, least(10::DOUBLE, sum((CASE t WHEN 'view' THEN 0.55 WHEN 'click' THEN 1.25 WHEN 'purchase' THEN 1.75 WHEN 'signup' THEN 1.5 WHEN 'error' THEN -1.5 ELSE 0 END)::DOUBLE * exp(-greatest(age, 0) / 14))
   + least(2::DOUBLE, count(DISTINCT s) * 0.35::DOUBLE) + least(2::DOUBLE, count(DISTINCT k) * 0.5::DOUBLE))), 2) AS reuse_value FROM x WHERE age <= 30 GROUP BY 1""",
    "u11_usage_dedup": "SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS hour, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "s03_event_upsert": "SELECT event_id, arg_max(event_type, created_at) AS event_type, arg_max(source_app, created_at) AS source_app, count(*) AS deliveries FROM memory_events GROUP BY 1 HAVING count(*) > 1",
    "a22_session_span": f"""SELECT m.*, f.confidence FROM (SELECT session_id, epoch_us(min(stored_at)) AS first_us, epoch_us(max(stored_at)) AS last_us FROM conversation_messages GROUP BY 1) m
LEFT JOIN (SELECT session_id, min({_RANK.format("confidence_level")}) AS confidence FROM fact_items GROUP BY 1) f USING (session_id)""",
}
