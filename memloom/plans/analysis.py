"""Further queries: candidates and conflicts of facts, relation search, funnels, diagnostics, groups of messages, relative times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions import temporal as tm
from memloom.operators import intervals as iv
from memloom.operators import retrieval as r
from memloom.operators.slices import running_sum
from memloom.plans import retrieval as rq
from memloom.plans import texts
from memloom.plans.problems import _P4_ROWS, timeline
from memloom.session import cut
from memloom.sources.tables import table

AS_OF = "2026-01-01 00:00:00"
# Words that say nothing about a topic.
STOP = ("the", "and", "for", "with", "from", "that", "this", "was", "were", "has", "have", "had", "are", "about", "what", "is", "in", "on", "of", "to", "its", "it", "as", "by", "at", "an")


def _facts(spark, d, *more):
    return table(spark, d, "fact_items", "fact_id", *more)


def w02_merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods per entity and axis; where there are more than 32, one from the first to the last."""
    p = iv.periods(timeline(spark, d), ["entity_id", "axis"])
    n = p.groupBy("entity_id", "axis").agg(F.count("*").alias("n"), F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    whole = n.where("n > 32").select("entity_id", "axis", F.col("s").alias("start_us"), F.col("e").alias("end_us"))
    return p.join(n.where("n <= 32").select("entity_id", "axis"), ["entity_id", "axis"], "left_semi").unionByName(whole)


def w10_latest_per_scope(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest events of each scope, redeliveries counted once; partial top-ten before the shuffle is Spark's (WindowGroupLimit)."""
    x = table(spark, d, "memory_events", "event_id", "context_scope_id", "created_at").where("context_scope_id IS NOT NULL").groupBy("context_scope_id", "event_id").agg(F.min("created_at").alias("at"))
    w = Window.partitionBy("context_scope_id").orderBy(F.desc("at"), "event_id")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("context_scope_id", "event_id", "rank")


def l06_keyset_window(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 events of a half-open window of arrival, after a cursor (time, id)."""
    x = table(spark, d, "memory_events", "event_id", "created_at").where("created_at >= timestamp'2025-03-01 00:00:00' AND created_at < timestamp'2025-04-01 00:00:00'")
    after = (F.col("created_at") > F.lit("2025-03-02 00:00:00").cast("timestamp")) | ((F.col("created_at") == F.lit("2025-03-02 00:00:00").cast("timestamp")) & (F.col("event_id") > "evt"))
    return x.where(after).orderBy("created_at", "event_id").limit(50).select("event_id", F.unix_micros("created_at").alias("at_us"))


def j06_temporal_exists(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose session stored a message within an hour of their observation."""
    f = _facts(spark, d, "session_id", "observed_at").where("session_id IS NOT NULL").dropDuplicates()
    m = table(spark, d, "conversation_messages", "session_id", "stored_at").dropDuplicates()
    near = (F.col("stored_at") >= F.col("observed_at") - F.expr("INTERVAL 1 HOUR")) & (F.col("stored_at") < F.col("observed_at") + F.expr("INTERVAL 1 HOUR"))
    return f.alias("f").join(m.alias("m"), (F.col("f.session_id") == F.col("m.session_id")) & near, "left_semi").select("fact_id").dropDuplicates()


def _topic(c):
    return F.array_distinct(F.filter(F.transform(sc.tokens(F.col(c)), sc.stem), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP)))


def j08_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every fact whose number is divisible by 100 with the facts it may be fused with: the same type and the same claim or a shared
    entity (the blocking keys), and for entities at least two shared topic words that are half of the smaller set."""
    f = _facts(spark, d, "fact_type", "normalized_claim", "entity_ids").dropDuplicates(["fact_id"]).withColumn("topic", _topic("normalized_claim"))
    claim = F.when(F.trim("normalized_claim") != "", F.concat(F.lit("c:"), F.sha2("normalized_claim", 256)))
    keys = F.array_compact(F.array_append(F.transform(F.coalesce("entity_ids", F.array().cast("array<string>")), lambda e: F.concat(F.lit("e:"), e)), claim))
    x = f.select("fact_id", "fact_type", "topic", F.explode(F.array_distinct(keys)).alias("key"))
    probes = x.where(F.regexp_extract("fact_id", r"(\d+)$", 1).try_cast("long") % 100 == 0)
    y = probes.join(x.select("fact_type", "key", F.col("fact_id").alias("other_id"), F.col("topic").alias("other")), ["fact_type", "key"]).where("fact_id <> other_id")
    shared, least = F.size(F.array_intersect("topic", "other")), F.least(F.size("topic"), F.size("other"))
    same = F.col("key").startswith("c:")
    y = y.where(same | ((shared >= 2) & (shared * 2 >= least)))
    return y.groupBy("fact_id", "other_id").agg(F.bool_or(same).alias("same_claim"), F.bool_or(~same).alias("shared_entity"))


def u09_first_of_claim(spark: SparkSession, d: str) -> DataFrame:
    """Facts that an earlier fact of the same claim stands for."""
    f = _facts(spark, d, "normalized_claim").where("trim(normalized_claim) <> ''").dropDuplicates()
    first = f.groupBy("normalized_claim").agg(F.min("fact_id").alias("kept"))
    return f.join(first, "normalized_claim").groupBy("fact_id").agg(F.min("kept").alias("kept")).where("fact_id <> kept")


def j16_conflict_context(spark: SparkSession, d: str) -> DataFrame:
    """Facts with conflicts: how many other facts they conflict with, and the smallest of them."""
    x = table(spark, d, "fusion_relations", "relation_id", "type", "source_fact_ids").where(F.lower(F.trim("type")) == "conflicts").select("relation_id", F.explode(F.array_distinct("source_fact_ids")).alias("fact_id")).where("fact_id IS NOT NULL")
    pairs = x.join(x.select("relation_id", F.col("fact_id").alias("other")), "relation_id").where("fact_id <> other")
    return pairs.groupBy("fact_id").agg(F.count_distinct("other").alias("conflicts"), F.min("other").alias("first"))


def j20_invalidation_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a withdrawn permission of each principal would touch: rows by table."""
    parts = [table(spark, d, t, "principal_id", k).select("principal_id", F.lit(t).alias("layer"), F.col(k).alias("id")) for t, k in (("memory_events", "event_id"), ("conversation_sessions", "session_id"), ("fact_items", "fact_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates().groupBy("principal_id", "layer").agg(F.count("*").alias("n"))


def j23_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Where the vectors of a query's label end up: retrieved, or not in the top k; per label."""
    probes = rq._probes(spark, d)
    hits = r.vector_top(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", probes, "vec_id", "embedding", rq.K).select("query_id", "vec_id")
    labels = table(spark, d, "embeddings", "vec_id", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    asked = probes.groupBy("label").agg(F.count("*").alias("probes"))
    x = hits.join(labels.withColumnRenamed("label", "found"), "vec_id").join(probes.select(F.col("vec_id").alias("query_id"), "label"), "query_id").where("found = label")
    got = x.groupBy("label").agg(F.count("*").alias("got"))
    x = asked.join(sizes, "label").join(got, "label", "left").withColumn("retrieved", F.coalesce("got", F.lit(0).cast("bigint")))
    return x.select("label", "retrieved", (F.col("probes") * F.col("n") - F.col("retrieved")).alias("not_in_top_k"))


def a13_selection_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many results each stage of the hybrid search leaves."""
    a, b = cut(rq._keyword(spark, d, rq.COARSE)), cut(rq._bm25(spark, d, rq.COARSE))
    fused = cut(r.fuse([a, b], "doc_id"))
    top = r.ranked(fused, "query_id", [F.desc("rrf"), F.col("doc_id")], rq.K)
    parts = [x.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents")).withColumn("stage", F.lit(s)) for s, x in (("keyword", a), ("bm25", b), ("fused", fused), ("selected", top))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def a16_bucket_totals(spark: SparkSession, d: str) -> DataFrame:
    """Token totals of each kind of document, and whether a single one exceeds the budget."""
    x = table(spark, d, "documents", "doc_type", "text").where("text IS NOT NULL").select("doc_type", sc.token_estimate(F.col("text")).alias("t"))
    return x.groupBy("doc_type").agg(F.sum("t").alias("tokens"), F.max("t").alias("largest"), F.bool_or(F.col("t") > 2000).alias("over_budget"))


def a18_conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    """Relations that restate each other: the same type over the same set of facts."""
    ids = F.concat_ws("|", F.array_sort(F.array_distinct(F.filter(F.transform("source_fact_ids", lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull()))))
    x = table(spark, d, "fusion_relations", "relation_id", "type", "source_fact_ids").select("relation_id", F.lower(F.trim("type")).alias("type"), ids.alias("facts")).where("type IS NOT NULL AND facts <> ''")
    return x.groupBy("type", "facts").agg(F.count("*").alias("n"), F.min("relation_id").alias("first")).where("n > 1")


def a06_entity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: its facts, its span of evidence, the weakest confidence, and its representative (strongest, then earliest)."""
    rank = F.when(F.col("valid_time_confidence") == "low", 0).when(F.col("valid_time_confidence") == "medium", 1).when(F.col("valid_time_confidence") == "high", 2)
    x = table(spark, d, "timeline_facts", "entity_id", "fact_id", "aggregation_id", "evidence_time_start", "evidence_time_end", "valid_time_confidence").withColumn("c", rank)
    best = F.min_by("aggregation_id", F.struct(-F.col("c"), F.col("evidence_time_start").isNull(), "evidence_time_start", "aggregation_id"))
    return x.groupBy("entity_id").agg(F.count_distinct("fact_id").alias("facts"), F.min(F.unix_micros("evidence_time_start")).alias("first_us"), F.max(F.unix_micros("evidence_time_end")).alias("last_us"), F.min("c").alias("confidence"), best.alias("representative"))


def a20_group_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Groups of messages up to a completed answer, with their estimated tokens."""
    x = table(spark, d, "conversation_messages", "session_id", "message_id", "sequence", "revision", "role", "status", "operation", "stored_at", "content")
    x = x.withColumn("t", sc.token_estimate(F.coalesce("content", F.lit("")))).groupBy("session_id", "message_id").agg(F.max_by(F.struct("sequence", "role", "status", "operation", "t"), F.struct("revision", "stored_at")).alias("m")).select("session_id", "message_id", "m.*")
    x = x.where("sequence IS NOT NULL AND operation <> 'delete'").withColumn("slice", F.floor(F.col("sequence") / 4096)).withColumn("_at", F.struct("sequence", "message_id"))
    ends = ((F.lower(F.trim("role")) == "assistant") & (F.col("status") == "completed")).cast("int")
    x = running_sum(x, ["session_id"], F.coalesce(ends, F.lit(0)), "_at", "group_no")
    g = x.groupBy("session_id", "group_no").agg(F.sum("t").alias("tokens"), F.count("*").alias("messages"))
    return g.groupBy("session_id").agg(F.count("*").alias("groups"), F.max("tokens").alias("largest"), F.sum("tokens").alias("tokens"))


def m07_time_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recency and staleness of every event at a given time, counted."""
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("created_at")) / 1e6
    return table(spark, d, "memory_events", "created_at").groupBy(sc.recency(age).alias("recency"), sc.staleness(age).alias("staleness")).agg(F.count("*").alias("n"))


def d02_relative_times(spark: SparkSession, d: str) -> DataFrame:
    """The days that relative event times name, seen from their arrival: (event_id, first, end) as days since 1970."""
    x = table(spark, d, "memory_events", "event_id", "event_time", "created_at").groupBy("event_id", "event_time").agg(F.min("created_at").alias("at"))
    x = x.withColumn("r", tm.relative_days(F.col("event_time"), F.col("at"))).where("r IS NOT NULL")
    return x.select("event_id", F.unix_date("r.first").alias("first"), F.unix_date("r.end").alias("end"))


def t12_character_containment(spark: SparkSession, d: str) -> DataFrame:
    """Facts by how much of the smaller character set of text and claim is in the other, in tenths."""
    a, b = (F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), ""), lambda x: x != "")) for c in ("fact_text", "normalized_claim"))
    x = _facts(spark, d, "fact_text", "normalized_claim").dropDuplicates().where((F.size(a) > 0) & (F.size(b) > 0))
    share = F.floor(10 * F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).cast("int")
    return x.groupBy(share.alias("tenths")).agg(F.count("*").alias("n"))


def t19_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms and two-word phrases of the queries without stop words, with the queries that hold them."""
    terms = F.filter(sc.tokens(F.col("query")), lambda w: ~w.isin(*STOP))
    phrases = F.zip_with(F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    x = table(spark, d, "eval_items", "item_id", "query").where("query IS NOT NULL").select("item_id", F.explode(F.array_distinct(F.concat(terms, phrases))).alias("term"))
    return x.groupBy("term").agg(F.count("*").alias("queries"))


def t29_lost_details(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose claim lost a number or a capitalised name of their text."""
    f = _facts(spark, d, "fact_text", "normalized_claim").dropDuplicates().where("trim(normalized_claim) <> ''")
    kept = F.array_distinct(F.transform(F.regexp_extract_all("fact_text", F.lit(r"[0-9]+|\b[A-Z][a-z]{3,}"), F.lit(0)), F.lower))
    lost = F.size(F.array_except(kept, sc.tokens(F.col("normalized_claim"))))
    return f.withColumn("lost", lost).groupBy("fact_id").agg(F.max("lost").alias("lost")).where("lost > 0")


def g06_identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose revisions disagree on what must not change: role, sequence or content type."""
    x = table(spark, d, "conversation_messages", "session_id", "message_id", "role", "sequence", "content_type")
    differs = lambda c, n: F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))), n)
    g = x.groupBy("session_id", "message_id").agg(F.concat_ws(",", differs("role", "role"), differs("sequence", "sequence"), differs("content_type", "content_type")).alias("fields"))
    return g.where("fields <> ''")


def g16_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    """The roles first and last of an entity's facts on the evidence axis."""
    x = table(spark, d, "timeline_facts", "entity_id", "aggregation_id", "evidence_time_start").where("evidence_time_start IS NOT NULL")
    g = x.groupBy("entity_id").agg(F.min(F.struct("evidence_time_start", "aggregation_id")).alias("a"), F.max(F.struct("evidence_time_start", "aggregation_id")).alias("b"))
    return g.select("entity_id", F.col("a.aggregation_id").alias("first"), F.col("b.aggregation_id").alias("last"))


def g17_best_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """Per session: the facts whose text and claim overlap best, ties within 0.05."""
    o = texts.t18_lexical_overlap(spark, d)
    s = _facts(spark, d, "session_id").where("session_id IS NOT NULL").dropDuplicates().join(o, "fact_id")
    best = s.groupBy("session_id").agg(F.max("overlap").alias("best"))
    return s.join(best, "session_id").where("overlap >= best - 0.05").select("session_id", "fact_id")


def f13_relation_search(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest relations of two types with high confidence."""
    x = table(spark, d, "fusion_relations", "relation_id", "type", "confidence_level", "created_at")
    x = x.where(F.lower(F.trim("type")).isin("updates", "supports") & (F.col("confidence_level") == "high")).orderBy(F.desc("created_at"), "relation_id").limit(50)
    return x.select("relation_id", F.lower(F.trim("type")).alias("type"), F.unix_micros("created_at").alias("at_us"))


def f14_relation_results(spark: SparkSession, d: str) -> DataFrame:
    """Relations with two known ends, scored by why they may matter: a known reason, a high confidence, both ends active."""
    f = _facts(spark, d, "version", "status").groupBy("fact_id").agg(F.max_by("status", F.struct("version", "status")).alias("status"))
    x = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids", "confidence_level", "reason_code").where("size(source_fact_ids) = 2").select("relation_id", "confidence_level", "reason_code", F.col("source_fact_ids")[0].alias("a"), F.col("source_fact_ids")[1].alias("b"))
    x = x.join(f.select(F.col("fact_id").alias("a"), F.col("status").alias("sa")), "a").join(f.select(F.col("fact_id").alias("b"), F.col("status").alias("sb")), "b")
    reasons = F.col("reason_code").isNotNull().cast("int") + F.coalesce((F.col("confidence_level") == "high").cast("int"), F.lit(0)) + ((F.col("sa") == "active") & (F.col("sb") == "active")).cast("int")
    return x.select("relation_id", F.round(0.5 + 0.1 * reasons, 1).alias("score"))


def u13_run_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Facts to look at again: carried over before due before new, each once, without those a relation names already."""
    f = _facts(spark, d, "status", "observed_at").dropDuplicates()
    cutoff = F.lit(AS_OF).cast("timestamp")
    why = F.when(F.col("status") == "conflicted", 0).when((F.col("status") == "superseded") & (F.col("observed_at") < cutoff), 1).when((F.col("status") == "active") & (F.col("observed_at") >= cutoff), 2)
    named = table(spark, d, "fusion_relations", "source_fact_ids").select(F.explode("source_fact_ids").alias("fact_id")).dropDuplicates()
    x = f.withColumn("priority", why).where("priority IS NOT NULL").groupBy("fact_id").agg(F.min("priority").alias("priority"))
    return x.join(named, "fact_id", "left_anti")


_K1 = rq._LISTS
_TOP = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_REL = "(SELECT *, lower(trim(type)) AS ty FROM fusion_relations)"
_RANK = "CASE valid_time_confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"
_AGE = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 1e6)"
_CHARS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), ''), lambda x: x <> ''))"

QUERIES = {
    f.__name__: f
    for f in (
        w02_merged_ranges, w10_latest_per_scope, l06_keyset_window, j06_temporal_exists, j08_candidates, u09_first_of_claim, j16_conflict_context, j20_invalidation_impact, j23_diagnostics, a13_selection_funnel, a16_bucket_totals,
        a18_conflict_groups, a06_entity_summary, a20_group_tokens, m07_time_scores, d02_relative_times, t12_character_containment, t19_query_terms, t29_lost_details, g06_identity_conflicts, g16_first_and_last, g17_best_with_ties,
        f13_relation_search, f14_relation_results, u13_run_candidates,
    )
}
SQL = {
    "w02_merged_ranges": _P4_ROWS
    + """, g AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
, p AS (SELECT entity_id, axis, min(s) AS s, max(e) AS e FROM g GROUP BY entity_id, axis, k), c AS (SELECT *, count(*) OVER (PARTITION BY entity_id, axis) AS n FROM p)
SELECT entity_id, axis, s AS start_us, e AS end_us FROM c WHERE n <= 32 UNION ALL SELECT entity_id, axis, min(s), max(e) FROM c WHERE n > 32 GROUP BY 1, 2""",
    "w10_latest_per_scope": """WITH x AS (SELECT context_scope_id, event_id, min(created_at) AS ts_ FROM memory_events WHERE context_scope_id IS NOT NULL GROUP BY 1, 2)
SELECT context_scope_id, event_id, row_number() OVER (PARTITION BY context_scope_id ORDER BY ts_ DESC, event_id)::INT AS rank FROM x QUALIFY rank <= 10""",
    "l06_keyset_window": """SELECT event_id, epoch_us(created_at) AS at_us FROM memory_events WHERE created_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2025-04-01 00:00:00+00'
 AND (created_at, event_id) > (TIMESTAMPTZ '2025-03-02 00:00:00+00', 'evt') ORDER BY created_at, event_id LIMIT 50""",
    "j06_temporal_exists": """SELECT DISTINCT fact_id FROM fact_items f WHERE EXISTS (SELECT 1 FROM conversation_messages m WHERE m.session_id = f.session_id AND m.stored_at >= f.observed_at - INTERVAL 1 HOUR AND m.stored_at < f.observed_at + INTERVAL 1 HOUR)""",
    "j08_candidates": f"""WITH f AS (SELECT DISTINCT fact_id, fact_type, normalized_claim AS c, entity_ids, list_distinct(list_filter(list_transform({_TOP.format("normalized_claim")}, lambda w: {rq._stem("w")}), lambda w: length(w) >= 2 AND w NOT IN ({_STOPS}))) AS topic FROM fact_items),
x AS (SELECT fact_id, fact_type, topic, 'e:' || unnest(list_distinct(entity_ids)) AS key FROM f UNION ALL SELECT fact_id, fact_type, topic, 'c:' || c FROM f WHERE trim(c) <> ''),
y AS (SELECT a.fact_id, b.fact_id AS other_id, a.key LIKE 'c:%' AS same, len(list_intersect(a.topic, b.topic)) AS sh, least(len(a.topic), len(b.topic)) AS le FROM x a JOIN x b ON a.fact_type = b.fact_type AND a.key = b.key AND a.fact_id <> b.fact_id
 WHERE TRY_CAST(regexp_extract(a.fact_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0)
SELECT fact_id, other_id, bool_or(same) AS same_claim, bool_or(NOT same) AS shared_entity FROM y WHERE same OR (sh >= 2 AND sh * 2 >= le) GROUP BY 1, 2""",
    "u09_first_of_claim": """SELECT fact_id, min(kept) AS kept FROM (SELECT fact_id, min(fact_id) OVER (PARTITION BY normalized_claim) AS kept FROM fact_items WHERE trim(normalized_claim) <> '') GROUP BY 1 HAVING min(kept) <> fact_id""",
    "j16_conflict_context": f"""WITH x AS (SELECT DISTINCT relation_id, unnest(source_fact_ids) AS f FROM {_REL} WHERE ty = 'conflicts')
SELECT a.f AS fact_id, count(DISTINCT b.f) AS conflicts, min(b.f) AS first FROM x a JOIN x b USING (relation_id) WHERE a.f <> b.f GROUP BY 1""",
    "j20_invalidation_impact": """SELECT principal_id, 'memory_events' AS layer, count(DISTINCT event_id) AS n FROM memory_events GROUP BY 1 UNION ALL SELECT principal_id, 'conversation_sessions', count(DISTINCT session_id) FROM conversation_sessions GROUP BY 1
UNION ALL SELECT principal_id, 'fact_items', count(DISTINCT fact_id) FROM fact_items GROUP BY 1""",
    "j23_diagnostics": rq._COS + f" , h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {rq.K} AS hit FROM s) SELECT la AS label, count(*) FILTER (WHERE hit) AS retrieved, count(*) FILTER (WHERE NOT hit) AS not_in_top_k FROM h WHERE la = lb GROUP BY 1",
    "a13_selection_funnel": rq._RRF
    + f""", best AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) <= {rq.K})
SELECT count(*) AS n, count(DISTINCT doc_id) AS documents, 'keyword' AS stage FROM k1 UNION ALL SELECT count(*), count(DISTINCT doc_id), 'bm25' FROM b1 UNION ALL SELECT count(*), count(DISTINCT doc_id), 'fused' FROM rf UNION ALL SELECT count(*), count(DISTINCT doc_id), 'selected' FROM best""",
    "a16_bucket_totals": f"SELECT doc_type, sum({texts._COST})::BIGINT AS tokens, max({texts._COST}) AS largest, bool_or({texts._COST} > 2000) AS over_budget FROM (SELECT doc_type, t FROM {texts._EST} JOIN (SELECT doc_id, doc_type FROM documents) USING (doc_id)) GROUP BY 1",
    "a18_conflict_groups": f"""WITH x AS (SELECT relation_id, ty AS type, array_to_string(list_sort(list_distinct(list_filter(list_transform(source_fact_ids, lambda x: lower(trim(x))), lambda x: x IS NOT NULL))), '|') AS facts FROM {_REL})
SELECT type, facts, count(*) AS n, min(relation_id) AS first FROM x WHERE type IS NOT NULL AND facts <> '' GROUP BY 1, 2 HAVING count(*) > 1""",
    "a06_entity_summary": f"""WITH x AS (SELECT *, {_RANK} AS c FROM timeline_facts)
SELECT entity_id, count(DISTINCT fact_id) AS facts, epoch_us(min(evidence_time_start)) AS first_us, epoch_us(max(evidence_time_end)) AS last_us, min(c) AS confidence,
 first(aggregation_id ORDER BY c DESC, evidence_time_start NULLS LAST, aggregation_id) AS representative FROM x GROUP BY 1""",
    "a20_group_tokens": f"""WITH l AS (SELECT session_id, message_id, sequence, role, status, trim(regexp_replace(coalesce(content, ''), '{texts.SPACES}', ' ', 'g'), ' ') AS t FROM (SELECT * FROM conversation_messages QUALIFY row_number() OVER (PARTITION BY session_id, message_id ORDER BY revision DESC, stored_at DESC) = 1) WHERE sequence IS NOT NULL AND operation <> 'delete'),
g AS (SELECT session_id, {texts._COST} AS t, coalesce(sum((coalesce(lower(trim(role, ' ')) = 'assistant' AND status = 'completed', false))::INT) OVER (PARTITION BY session_id ORDER BY sequence, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM l),
s AS (SELECT session_id, k, sum(t)::BIGINT AS t FROM g GROUP BY 1, 2) SELECT session_id, count(*) AS groups, max(t) AS largest, sum(t)::BIGINT AS tokens FROM s GROUP BY 1""",
    "m07_time_scores": f"""SELECT (CASE WHEN abs({_AGE}) < 3600 THEN 1.0 WHEN abs({_AGE}) < 86400 THEN 0.8 WHEN abs({_AGE}) < 604800 THEN 0.6 ELSE 0.3 END)::DOUBLE AS recency,
 (CASE WHEN {_AGE} < 604800 THEN 0 WHEN {_AGE} < 2592000 THEN 0.2 ELSE 0.5 END)::DOUBLE AS staleness, count(*) AS n FROM memory_events GROUP BY 1, 2""",
    "d02_relative_times": r"""WITH x AS (SELECT event_id, lower(event_time) AS t, (min(created_at) AT TIME ZONE 'UTC')::DATE AS d FROM memory_events GROUP BY event_id, event_time),
w AS (SELECT *, list_position(['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday'], regexp_extract(t, '\b(?:last|this|next) (\w+day)\b', 1)) AS n FROM x),
s AS (SELECT *, ((dayofweek(d) + 1 - n) % 7 + 7) % 7 AS df FROM w),
r AS (SELECT event_id, CASE WHEN t LIKE '%yesterday%' THEN d - 1 WHEN n > 0 AND t LIKE '%last%' THEN d - (CASE WHEN df = 0 THEN 7 ELSE df END)::INT WHEN n > 0 AND t LIKE '%this%' THEN d - df::INT WHEN n > 0 THEN d + (7 - df)::INT END AS f FROM s)
SELECT event_id, (f - DATE '1970-01-01')::INT AS first, (f - DATE '1970-01-01')::INT + 1 AS end FROM r WHERE f IS NOT NULL""",
    "t12_character_containment": f"""WITH x AS (SELECT {_CHARS.format("fact_text")} AS a, {_CHARS.format("normalized_claim")} AS b FROM (SELECT DISTINCT fact_id, fact_text, normalized_claim FROM fact_items))
SELECT floor(10 * len(list_intersect(a, b)) / least(len(a), len(b)))::INT AS tenths, count(*) AS n FROM x WHERE len(a) > 0 AND len(b) > 0 GROUP BY 1""",
    "t19_query_terms": f"""WITH q AS (SELECT item_id, list_filter({_TOP.format("query")}, lambda w: w NOT IN ({_STOPS})) AS t FROM eval_items WHERE query IS NOT NULL),
x AS (SELECT item_id, unnest(t) AS term FROM q UNION SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM q) SELECT term, count(*) AS queries FROM x GROUP BY 1""",
    "t29_lost_details": f"""WITH x AS (SELECT fact_id, list_distinct(list_transform(regexp_extract_all(fact_text, '[0-9]+|\\b[A-Z][a-z]{{3,}}'), lambda w: lower(w))) AS k, {_TOP.format("normalized_claim")} AS c FROM fact_items WHERE trim(normalized_claim) <> '')
SELECT fact_id, max(len(list_filter(k, lambda w: NOT list_contains(c, w))))::INT AS lost FROM x GROUP BY 1 HAVING max(len(list_filter(k, lambda w: NOT list_contains(c, w)))) > 0""",
    "g06_identity_conflicts": """WITH g AS (SELECT session_id, message_id, concat_ws(',', CASE WHEN min(role) <> max(role) OR (count(role) > 0 AND count(role) < count(*)) THEN 'role' END, CASE WHEN min(sequence) <> max(sequence) OR (count(sequence) > 0 AND count(sequence) < count(*)) THEN 'sequence' END,
 CASE WHEN min(content_type) <> max(content_type) OR (count(content_type) > 0 AND count(content_type) < count(*)) THEN 'content_type' END) AS fields FROM conversation_messages GROUP BY 1, 2) SELECT * FROM g WHERE fields <> ''""",
    "g16_first_and_last": "SELECT entity_id, arg_min(aggregation_id, (evidence_time_start, aggregation_id)) AS first, arg_max(aggregation_id, (evidence_time_start, aggregation_id)) AS last FROM timeline_facts WHERE evidence_time_start IS NOT NULL GROUP BY 1",
    "g17_best_with_ties": f"""WITH o AS ({texts.SQL["t18_lexical_overlap"]}), s AS (SELECT DISTINCT session_id, fact_id, overlap FROM fact_items JOIN o USING (fact_id) WHERE session_id IS NOT NULL)
SELECT session_id, fact_id FROM s QUALIFY overlap >= max(overlap) OVER (PARTITION BY session_id) - 0.05::DOUBLE""",
    "f13_relation_search": f"SELECT relation_id, ty AS type, epoch_us(created_at) AS at_us FROM {_REL} WHERE ty IN ('updates', 'supports') AND confidence_level = 'high' ORDER BY created_at DESC, relation_id LIMIT 50",
    "f14_relation_results": """WITH f AS (SELECT fact_id, arg_max(status, (version, status)) AS s FROM fact_items GROUP BY 1)
SELECT relation_id, round(0.5::DOUBLE + 0.1::DOUBLE * ((reason_code IS NOT NULL)::INT + coalesce((confidence_level = 'high')::INT, 0) + (a.s = 'active' AND b.s = 'active')::INT), 1) AS score
FROM fusion_relations r JOIN f a ON a.fact_id = r.source_fact_ids[1] JOIN f b ON b.fact_id = r.source_fact_ids[2] WHERE len(source_fact_ids) = 2""",
    "u13_run_candidates": f"""WITH f AS (SELECT fact_id, CASE WHEN status = 'conflicted' THEN 0 WHEN status = 'superseded' AND observed_at < TIMESTAMPTZ '{AS_OF}+00' THEN 1 WHEN status = 'active' AND observed_at >= TIMESTAMPTZ '{AS_OF}+00' THEN 2 END AS p FROM fact_items)
SELECT fact_id, min(p) AS priority FROM f WHERE p IS NOT NULL AND fact_id NOT IN (SELECT x FROM (SELECT unnest(source_fact_ids) AS x FROM fusion_relations) WHERE x IS NOT NULL) GROUP BY 1""",
}
