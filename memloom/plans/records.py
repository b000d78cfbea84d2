"""Record queries: scope, validation, ordering, supplements, batches, ids and cursors of facts, events, relations and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import retrieval as r
from memloom.plans import retrieval as rq
from memloom.session import cut
from memloom.sources.tables import table

TENANT = "tnt_01"
SOURCES = ("src_0007", "mail-bridge", "scope_072")
LINKS = ("same_event", "supports", "updates")
FROM, TO = "2025-01-01 00:00:00", "2025-07-01 00:00:00"

# Relative times that name no definite day, so that they do not filter.
_COUNT = r"(?:an?|\d+|one|two|three|four|five|six|seven|eight|nine|ten|few|several|couple(?: of)?)"
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
AMBIGUOUS = (
    r"\b(?:recently|lately|recent)\b|最近|近期|近来|前段时间|不久前|\b(?:last|past)\s+(?:month|year)\b"
    rf"|\b(?:last|this|next)\s+(?:{_DAYS})\b|\b(?:about|around|approximately)\s+{_COUNT}\s+(?:minutes?|hours?|days?|weeks?|months?|years?)\s+ago\b"
    rf"|\b{_COUNT}\s+(?:weeks?|months?|years?)\s+ago\b"
)


def owner_scope(df: DataFrame, tenant: str | None = None, principal: str | None = None, scope: str | None = None, inactive: bool = False) -> DataFrame:
    """The rows of an owner; every part is optional. Unless inactive, only those with an active or conflicted status."""
    for column, value in (("tenant_id", tenant), ("principal_id", principal), ("context_scope_id", scope)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if inactive else df.where(F.col("status").isin("active", "conflicted"))


def f01_owner_scope(spark: SparkSession, d: str) -> DataFrame:
    return owner_scope(table(spark, d, "fact_items", "fact_id", "tenant_id", "status", "version"), TENANT).select("fact_id", "version", "status").dropDuplicates()


def f05_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Facts that relations of some types name, whose owner exists in a tenant and was observed in a range."""
    ends = table(spark, d, "fusion_relations", "type", "source_fact_ids").where(F.lower(F.trim("type")).isin(*LINKS)).select(F.explode("source_fact_ids").alias("fact_id"))
    ends = ends.where("fact_id IS NOT NULL").dropDuplicates()
    facts = table(spark, d, "fact_items", "fact_id", "tenant_id", "observed_at").where((F.col("tenant_id") == TENANT) & (F.col("observed_at") >= F.lit(FROM).cast("timestamp")) & (F.col("observed_at") < F.lit(TO).cast("timestamp")))
    return ends.join(facts, "fact_id", "left_semi")


def f10_source_match(spark: SparkSession, d: str) -> DataFrame:
    """Events whose source, app or any other reference is one of those asked for."""
    refs = F.array("source_id", "source_app", "context_scope_id")
    x = table(spark, d, "memory_events", "event_id", "source_id", "source_app", "context_scope_id")
    return x.where(F.exists(refs, lambda v: F.coalesce(v.isin(*SOURCES), F.lit(False)))).select("event_id").dropDuplicates()


def f15_change_events(spark: SparkSession, d: str) -> DataFrame:
    """The latest page of a tenant's events of one kind."""
    x = table(spark, d, "memory_events", "event_id", "tenant_id", "event_type", "created_at").where((F.col("tenant_id") == TENANT) & (F.col("event_type") == "document"))
    x = x.groupBy("event_id").agg(F.max("created_at").alias("at"))
    return x.orderBy(F.desc("at"), "event_id").limit(50).select("event_id", F.unix_micros("at").alias("at_us"))


def f19_ambiguous_time(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a relative time that names no definite day."""
    x = table(spark, d, "conversation_messages", "conversation_message_row_id", "content")
    return x.where(F.lower("content").rlike(AMBIGUOUS)).select(F.col("conversation_message_row_id").alias("row_id")).dropDuplicates()


def _first_reason(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in rules))


def f20_fact_validation(spark: SparkSession, d: str) -> DataFrame:
    """The first fault of each faulty fact or timeline row."""
    facts = table(spark, d, "fact_items", "fact_id", "fact_text", "normalized_claim", "observed_at")
    missing = [(F.coalesce(F.col(c), F.lit("")) == "", f"{c}_required") for c in ("fact_id", "fact_text", "normalized_claim")]
    one = facts.select("fact_id", _first_reason(*missing, (F.col("observed_at").isNull(), "observed_at_invalid")).alias("reason"))
    order = [(F.coalesce(F.col(f"{a}_time_end") < F.col(f"{a}_time_start"), F.lit(False)), f"{a}_time_end_before_start") for a in ("valid", "evidence")]
    two = table(spark, d, "timeline_facts", "fact_id", "valid_time_start", "valid_time_end", "evidence_time_start", "evidence_time_end").select("fact_id", _first_reason(*order).alias("reason"))
    return one.unionByName(two).where("reason IS NOT NULL").dropDuplicates()


def d12_range_check(spark: SparkSession, d: str) -> DataFrame:
    """Timeline rows by axis and what is wrong with their range: a bound that is missing, or a start that is not before the end."""
    part = lambda a: F.struct(F.lit(a).alias("axis"), F.col(f"{a}_time_start").alias("s"), F.col(f"{a}_time_end").alias("e"))
    x = table(spark, d, "timeline_facts", *(f"{a}_time_{b}" for a in ("valid", "evidence") for b in ("start", "end"))).select(F.explode(F.array(part("valid"), part("evidence"))).alias("x")).select("x.*")
    reason = F.when(F.col("s").isNull() | F.col("e").isNull(), "open").when(F.col("s") >= F.col("e"), "not_before_end").otherwise("valid")
    return x.groupBy("axis", reason.alias("reason")).agg(F.count("*").alias("n"))


def j02_owner_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What the ids in relations stand for: a fact with a timeline, a fact, or nothing known."""
    ids = table(spark, d, "fusion_relations", "source_fact_ids").select(F.explode("source_fact_ids").alias("id")).where("id IS NOT NULL").dropDuplicates()
    facts = table(spark, d, "fact_items", "fact_id").dropDuplicates().select(F.col("fact_id").alias("id"), F.lit(1).alias("f"))
    lines = table(spark, d, "timeline_facts", "fact_id").groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("t"))
    kind = F.when(F.col("f").isNull(), "unknown").when(F.col("t").isNull(), "fact").otherwise("timeline")
    return ids.join(facts, "id", "left").join(lines, "id", "left").select("id", kind.alias("owner"), F.coalesce("t", F.lit(0).cast("bigint")).alias("timelines"))


def j21_score_join_back(spark: SparkSession, d: str) -> DataFrame:
    """The keyword ranking put in the order of a second score, joined by query and document; rows it does not know come last."""
    docs, asked = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "query")
    base = r.keyword_top(docs, "doc_id", "text", asked, "item_id", "query", rq.K).select("query_id", "doc_id", F.col("rank").alias("before"))
    second = r.bm25_top(docs, "doc_id", "text", asked, "item_id", "query", rq.COARSE).select("query_id", "doc_id", "score")
    x = base.join(second, ["query_id", "doc_id"], "left")
    return r.ranked(x, "query_id", [F.desc_nulls_last("score"), F.col("before")]).select("query_id", "doc_id", "before", "score", "rank")


def u04_supplement(spark: SparkSession, d: str) -> DataFrame:
    """The keyword ranking, followed by what the BM25 ranking has besides."""
    docs, asked = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "query")
    base = cut(r.keyword_top(docs, "doc_id", "text", asked, "item_id", "query", rq.K).select("query_id", "doc_id", "rank"))
    more = r.bm25_top(docs, "doc_id", "text", asked, "item_id", "query", rq.K).select("query_id", "doc_id", "rank").join(base.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return base.withColumn("part", F.lit("base")).unionByName(more.withColumn("part", F.lit("supplement")))


def g18_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """What became of every candidate of both rankings: selected, or below the cut of the ranking that has it."""
    docs, asked = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "query")
    a = r.keyword_top(docs, "doc_id", "text", asked, "item_id", "query", rq.COARSE).select("query_id", "doc_id", F.col("rank").alias("keyword_rank"))
    b = r.bm25_top(docs, "doc_id", "text", asked, "item_id", "query", rq.COARSE).select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))
    k, m = F.col("keyword_rank"), F.col("bm25_rank")
    status = F.when(F.least(F.coalesce(k, m), F.coalesce(m, k)) <= rq.K, "selected").when(k.isNull(), "bm25_only").when(m.isNull(), "keyword_only").otherwise("both_below")
    return a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", "keyword_rank", "bm25_rank", status.alias("status"))


def l08_candidate_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred facts by version (for importance), confidence, freshness and id."""
    x = table(spark, d, "fact_items", "fact_id", "version", "confidence_level", "observed_at").dropDuplicates()
    rank = F.when(F.col("confidence_level") == "high", 3).when(F.col("confidence_level") == "medium", 2).when(F.col("confidence_level") == "low", 1).otherwise(0)
    x = x.withColumn("confidence", rank).orderBy(F.desc("version"), F.desc("confidence"), F.desc("observed_at"), "fact_id").limit(100)
    return x.select("fact_id", "version", "confidence", F.unix_micros("observed_at").alias("at_us"))


def l10_due_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred messages by when they were completed or, failing that, stored."""
    x = table(spark, d, "conversation_messages", "conversation_message_row_id", "completed_at", "stored_at")
    x = x.groupBy(F.col("conversation_message_row_id").alias("row_id")).agg(F.min(F.coalesce("completed_at", "stored_at")).alias("due"))
    return x.orderBy("due", "row_id").limit(100).select("row_id", F.unix_micros("due").alias("due_us"))


def r03_superset(spark: SparkSession, d: str) -> DataFrame:
    """Facts that name every entity of their session, where it has at least two."""
    x = table(spark, d, "fact_items", "fact_id", "session_id", "entity_ids").where("session_id IS NOT NULL").select("session_id", "fact_id", F.explode("entity_ids").alias("e")).where("e IS NOT NULL").dropDuplicates()
    required = x.select("session_id", "e").dropDuplicates().groupBy("session_id").agg(F.count("*").alias("n")).where("n >= 2")
    return x.groupBy("session_id", "fact_id").agg(F.count("*").alias("n")).join(required, ["session_id", "n"]).select("session_id", "fact_id")


def u12_equal_batches(spark: SparkSession, d: str) -> DataFrame:
    """Relations that name the same facts in whatever order and spelling: how many, by size. Lists are compared without case, blanks and repeats."""
    x = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("source_fact_ids", lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))))
    x = x.select("relation_id", ids.alias("ids")).where(F.size("ids") > 0).groupBy("ids").agg(F.count("*").alias("n"), F.min("relation_id").alias("first")).where("n > 1")
    return x.select("first", "n", F.size("ids").alias("facts"))


def u14_merged_refs(spark: SparkSession, d: str) -> DataFrame:
    """The entities of each fact over all its rows, trimmed, each once, in order."""
    x = table(spark, d, "fact_items", "fact_id", "entity_ids").select("fact_id", F.explode("entity_ids").alias("e")).select("fact_id", F.trim("e").alias("e")).where("e <> ''").dropDuplicates()
    return x.groupBy("fact_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("e"))).alias("entities"))


def t31_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    """An id for each relation's first edge from its type and ends, with letters, digits and _-:. only."""
    x = table(spark, d, "fusion_relations", "relation_id", "type", "source_fact_ids").where("size(source_fact_ids) >= 2 AND type IS NOT NULL")
    raw = F.concat_ws("->", "type", F.coalesce(F.get("source_fact_ids", F.lit(0)), F.lit("?")), F.coalesce(F.get("source_fact_ids", F.lit(1)), F.lit("?")))
    return x.select("relation_id", F.regexp_replace(raw, r"[^a-zA-Z0-9_\-:.]", "_").alias("edge_id"))


def t33_language(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each declared language hold Han text."""
    x = table(spark, d, "documents", "lang", "text").where("text IS NOT NULL")
    return x.groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count_if(F.col("text").rlike(r"\p{IsHan}")).alias("han"), F.count("*").alias("n"))


def r06_stable_json(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each fact's main fields as JSON with sorted keys."""
    x = table(spark, d, "fact_items", "fact_id", "fact_type", "status", "version").dropDuplicates()
    return x.select("fact_id", "version", F.sha2(F.to_json(F.struct("fact_id", "fact_type", "status", "version"), {"ignoreNullFields": "false"}), 256).alias("digest"))


def encode_cursor(**parts: Column) -> Column:
    """An opaque page cursor of the given parts, by name."""
    return F.base64(F.encode(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), "UTF-8"))


def decode_cursor(cursor: Column, schema: str) -> Column:
    """The parts of a cursor; null for one that was not made by encode_cursor."""
    return F.from_json(F.decode(F.try_to_binary(cursor, F.lit("base64")), "UTF-8"), schema)


def r08_page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """The cursor behind the largest fact of each type and status."""
    x = table(spark, d, "fact_items", "fact_id", "fact_type", "status").where("fact_type IS NOT NULL AND status IS NOT NULL").groupBy("fact_type", "status").agg(F.max("fact_id").alias("id"))
    return x.select("fact_type", "status", encode_cursor(id=F.col("id"), layer=F.col("fact_type")).alias("cursor"))


_KW, _BM = rq._keyword_sql(rq._DOCS, "doc_id"), rq._BM
QUERIES = {
    f.__name__: f
    for f in (
        f01_owner_scope, f05_graph_nodes, f10_source_match, f15_change_events, f19_ambiguous_time, f20_fact_validation, d12_range_check, j02_owner_kinds, j21_score_join_back, u04_supplement,
        g18_waterfall, l08_candidate_order, l10_due_order, r03_superset, u12_equal_batches, u14_merged_refs, t31_edge_ids, t33_language, r06_stable_json, r08_page_cursors,
    )
}
SQL = {
    "f01_owner_scope": f"SELECT DISTINCT fact_id, version, status FROM fact_items WHERE tenant_id = '{TENANT}' AND status IN ('active', 'conflicted')",
    "f05_graph_nodes": f"""SELECT DISTINCT id AS fact_id FROM (SELECT unnest(source_fact_ids) AS id FROM fusion_relations WHERE lower(trim(type)) IN {LINKS})
WHERE id IN (SELECT fact_id FROM fact_items WHERE tenant_id = '{TENANT}' AND observed_at >= TIMESTAMPTZ '{FROM}+00' AND observed_at < TIMESTAMPTZ '{TO}+00')""",
    "f10_source_match": f"SELECT DISTINCT event_id FROM memory_events WHERE source_id IN {SOURCES} OR source_app IN {SOURCES} OR context_scope_id IN {SOURCES}",
    "f15_change_events": f"SELECT event_id, epoch_us(max(created_at)) AS at_us FROM memory_events WHERE tenant_id = '{TENANT}' AND event_type = 'document' GROUP BY event_id ORDER BY at_us DESC, event_id LIMIT 50",
    "f19_ambiguous_time": f"SELECT DISTINCT conversation_message_row_id AS row_id FROM conversation_messages WHERE regexp_matches(lower(content), '{AMBIGUOUS}')",
    "f20_fact_validation": """SELECT DISTINCT fact_id, reason FROM (
SELECT fact_id, CASE WHEN coalesce(fact_id, '') = '' THEN 'fact_id_required' WHEN coalesce(fact_text, '') = '' THEN 'fact_text_required' WHEN coalesce(normalized_claim, '') = '' THEN 'normalized_claim_required'
  WHEN observed_at IS NULL THEN 'observed_at_invalid' END AS reason FROM fact_items
UNION ALL SELECT fact_id, CASE WHEN valid_time_end < valid_time_start THEN 'valid_time_end_before_start' WHEN evidence_time_end < evidence_time_start THEN 'evidence_time_end_before_start' END FROM timeline_facts) WHERE reason IS NOT NULL""",
    "d12_range_check": """SELECT axis, CASE WHEN s IS NULL OR e IS NULL THEN 'open' WHEN s >= e THEN 'not_before_end' ELSE 'valid' END AS reason, count(*) AS n FROM (
SELECT 'valid' AS axis, valid_time_start AS s, valid_time_end AS e FROM timeline_facts UNION ALL SELECT 'evidence', evidence_time_start, evidence_time_end FROM timeline_facts) GROUP BY 1, 2""",
    "j02_owner_kinds": """WITH i AS (SELECT DISTINCT id FROM (SELECT unnest(source_fact_ids) AS id FROM fusion_relations) WHERE id IS NOT NULL), t AS (SELECT fact_id AS id, count(*) AS t FROM timeline_facts GROUP BY 1)
SELECT i.id, CASE WHEN i.id NOT IN (SELECT fact_id FROM fact_items WHERE fact_id IS NOT NULL) THEN 'unknown' WHEN t IS NULL THEN 'fact' ELSE 'timeline' END AS owner, coalesce(t, 0) AS timelines FROM i LEFT JOIN t USING (id)""",
    "j21_score_join_back": f"""WITH {_KW}, {_BM}, a AS ({rq._rank("kw", "doc_id", rq.K)}), b AS ({rq._rank("bm", "doc_id", rq.COARSE)})
SELECT a.query_id, a.doc_id, a.rank AS before, b.score, row_number() OVER (PARTITION BY a.query_id ORDER BY b.score DESC NULLS LAST, a.rank)::INT AS rank FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id""",
    "u04_supplement": f"""WITH {_KW}, {_BM}, a AS ({rq._rank("kw", "doc_id", rq.K)}), b AS ({rq._rank("bm", "doc_id", rq.K)})
SELECT query_id, doc_id, rank, 'base' AS part FROM a UNION ALL SELECT query_id, doc_id, rank, 'supplement' FROM b WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM a)""",
    "g18_waterfall": f"""WITH {_KW}, {_BM}, a AS ({rq._rank("kw", "doc_id", rq.COARSE)}), b AS ({rq._rank("bm", "doc_id", rq.COARSE)})
SELECT query_id, doc_id, a.rank AS keyword_rank, b.rank AS bm25_rank, CASE WHEN least(coalesce(a.rank, b.rank), coalesce(b.rank, a.rank)) <= {rq.K} THEN 'selected' WHEN a.rank IS NULL THEN 'bm25_only' WHEN b.rank IS NULL THEN 'keyword_only' ELSE 'both_below' END AS status
FROM a FULL JOIN b USING (query_id, doc_id)""",
    "l08_candidate_order": """SELECT fact_id, version, CASE confidence_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS confidence, epoch_us(observed_at) AS at_us
FROM (SELECT DISTINCT fact_id, version, confidence_level, observed_at FROM fact_items) ORDER BY version DESC, confidence DESC, observed_at DESC NULLS LAST, fact_id LIMIT 100""",
    "l10_due_order": "SELECT conversation_message_row_id AS row_id, epoch_us(min(coalesce(completed_at, stored_at))) AS due_us FROM conversation_messages GROUP BY 1 ORDER BY due_us NULLS FIRST, row_id LIMIT 100",
    "r03_superset": """WITH x AS (SELECT DISTINCT session_id, fact_id, e FROM (SELECT session_id, fact_id, unnest(entity_ids) AS e FROM fact_items WHERE session_id IS NOT NULL) WHERE e IS NOT NULL),
q AS (SELECT session_id, count(DISTINCT e) AS n FROM x GROUP BY 1) SELECT session_id, fact_id FROM x JOIN q USING (session_id) WHERE n >= 2 GROUP BY session_id, fact_id, n HAVING count(*) = n""",
    "u12_equal_batches": """WITH x AS (SELECT relation_id, list_sort(list_distinct(list_filter(list_transform(source_fact_ids, lambda v: lower(trim(v))), lambda v: v IS NOT NULL AND v <> ''))) AS ids FROM fusion_relations)
SELECT min(relation_id) AS first, count(*) AS n, len(ids)::INT AS facts FROM x WHERE len(ids) > 0 GROUP BY ids HAVING count(*) > 1""",
    "u14_merged_refs": "SELECT fact_id, string_agg(e, ',' ORDER BY e) AS entities FROM (SELECT DISTINCT fact_id, trim(e) AS e FROM (SELECT fact_id, unnest(entity_ids) AS e FROM fact_items)) WHERE e <> '' GROUP BY fact_id",
    "t31_edge_ids": r"SELECT relation_id, regexp_replace(concat_ws('->', type, coalesce(source_fact_ids[1], '?'), coalesce(source_fact_ids[2], '?')), '[^a-zA-Z0-9_\-:.]', '_', 'g') AS edge_id FROM fusion_relations WHERE len(source_fact_ids) >= 2 AND type IS NOT NULL",
    "t33_language": r"SELECT lower(trim(lang)) AS lang, count(*) FILTER (WHERE regexp_matches(text, '\p{Han}')) AS han, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "r06_stable_json": "SELECT DISTINCT fact_id, version, sha256(to_json({fact_id: fact_id, fact_type: fact_type, status: status, version: version})::VARCHAR) AS digest FROM fact_items",
    "r08_page_cursors": "SELECT fact_type, status, base64(encode(to_json({id: max(fact_id), layer: fact_type})::VARCHAR)) AS cursor FROM fact_items WHERE fact_type IS NOT NULL AND status IS NOT NULL GROUP BY fact_type, status",
}
