"""Lineage, coverage and housekeeping queries: validation, evidence chains, summaries, representatives, cutoffs, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions import temporal as tm
from memloom.operators import retrieval as r
from memloom.operators.components import components_by_keys
from memloom.plans import retrieval as rq
from memloom.plans import texts
from memloom.plans.memory import FROM, TO, ZONE, _V
from memloom.sources import formats
from memloom.sources.tables import table

ROLES = ("user", "assistant", "tool", "system")


def s06_document_validation(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with session files: no batch id, no session block, a block that is no JSON, an unknown role, an empty message."""
    x = table(spark, d, "documents", "doc_id", "text", "doc_type").where("doc_type = 'session_file' AND text IS NOT NULL")
    x = x.withColumn("b", F.regexp_extract_all("text", F.lit(formats._BLOCK), F.lit(1)))
    m = F.flatten(F.filter(F.transform("b", lambda j: F.from_json(j, formats.SESSION)["messages"]), lambda a: a.isNotNull()))
    rules = {
        "no_batch_id": F.regexp_extract("text", r"(?m)^batch_id:[ \t]*(\S+)", 1) == "", "no_session": F.size("b") == 0, "bad_json": F.exists("b", lambda j: F.get_json_object(j, "$.sessionId").isNull()),
        "bad_role": F.exists(m, lambda e: ~F.coalesce(e["role"].isin(*ROLES), F.lit(False))), "empty_message": F.exists(m, lambda e: F.trim(F.coalesce(e["content"], F.lit(""))) == ""),
    }
    return x.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("code"))


def s15_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table by tenant."""
    parts = [table(spark, d, t, "tenant_id").groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("layer"), "tenant_id", "n") for t in ("memory_events", "conversation_sessions", "fact_items")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def f07_refined_match(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose valid envelope meets the range and, as they have timed facts, one of whose facts does."""
    x = table(spark, d, "timeline_facts", "entity_id", "valid_time_start", "valid_time_end").where("valid_time_start IS NOT NULL")
    lo, hi = F.lit(FROM).cast("timestamp"), F.lit(TO).cast("timestamp")
    g = x.groupBy("entity_id").agg(F.min("valid_time_start").alias("s"), F.max(F.coalesce("valid_time_end", "valid_time_start")).alias("e"), F.bool_or(tm.intersects(F.col("valid_time_start"), F.col("valid_time_end"), lo, hi)).alias("one"))
    return g.where(tm.intersects(F.col("s"), F.col("e"), lo, hi) & F.col("one")).select("entity_id")


def j04_owners_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Facts that share an entity with a fact whose number is divisible by 100."""
    x = table(spark, d, "fact_items", "fact_id", "entity_ids").select("fact_id", F.explode(F.array_distinct("entity_ids")).alias("e")).dropDuplicates()
    asked = x.where(F.regexp_extract("fact_id", r"(\d+)$", 1).try_cast("long") % 100 == 0).select("e").dropDuplicates()
    return x.join(asked, "e", "left_semi").select("fact_id").dropDuplicates()


def j14_evidence_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: facts, sessions and messages that its timeline rests on."""
    t = table(spark, d, "timeline_facts", "entity_id", "fact_id").dropDuplicates()
    f = table(spark, d, "fact_items", "fact_id", "session_id").dropDuplicates()
    m = table(spark, d, "conversation_messages", "session_id", "message_id").dropDuplicates().groupBy("session_id").agg(F.count("*").alias("m"))
    x = t.join(f, "fact_id").select("entity_id", "fact_id", "session_id")
    facts = x.groupBy("entity_id").agg(F.count_distinct("fact_id").alias("facts"))
    sessions = x.where("session_id IS NOT NULL").select("entity_id", "session_id").dropDuplicates().join(m, "session_id", "left").groupBy("entity_id").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"))
    return facts.join(sessions, "entity_id", "left")


def a02_term_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per document: tokens and distinct tokens."""
    t = sc.tokens(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def a07_event_merge(spark: SparkSession, d: str) -> DataFrame:
    """One event for each principal, type and day of arrival: the last, with the number merged."""
    x = table(spark, d, "memory_events", "event_id", "principal_id", "event_type", "created_at").groupBy("event_id", "principal_id", "event_type").agg(F.min("created_at").alias("at"))
    return x.groupBy("principal_id", "event_type", F.unix_date(F.to_date("at")).alias("day")).agg(F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"), F.count("*").alias("n")).where("n > 1")


def a14_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fact_items", "fact_id", "fact_type", "status").dropDuplicates()
    return x.groupBy("fact_type").pivot("status", ["active", "superseded", "conflicted", "rejected"]).agg(F.count(F.lit(1))).na.fill(0)


def a15_window_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per principal: the latest cursor (time, id) and the number of events, at most 100."""
    x = table(spark, d, "memory_events", "event_id", "principal_id", "created_at").groupBy("principal_id", "event_id").agg(F.max("created_at").alias("at"))
    g = x.groupBy("principal_id").agg(F.max(F.struct("at", "event_id")).alias("c"), F.least(F.count("*"), F.lit(100)).alias("n"))
    return g.select("principal_id", F.unix_micros("c.at").alias("at_us"), "c.event_id", "n")


def a21_session_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversation_sessions", "source_app", "document_status", "temporal_mode")
    return x.groupBy("source_app").agg(F.count("*").alias("n"), F.count_distinct("document_status").alias("states"), F.round(F.avg((F.col("temporal_mode").isNull()).cast("double")), 6).alias("without_mode"))


def m12_route_signals(spark: SparkSession, d: str) -> DataFrame:
    """How far each query lends itself to keyword, graph and time retrieval."""
    t = F.array_distinct(sc.tokens(F.col("query")))
    x = table(spark, d, "eval_items", "item_id", "query").where("query IS NOT NULL")
    return x.select(
        "item_id", F.when(F.size(t) > 0, F.least(F.lit(1.0), F.size(t) / 4)).otherwise(0.2).alias("keyword"), F.when(F.exists(t, lambda w: F.length(w) > 1), 0.5).otherwise(0.2).alias("graph"),
        F.when(F.exists(t, lambda w: w.rlike(r"\d{4}|today|recent")), 0.8).otherwise(0.3).alias("time"),
    )


def m23_evidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the share of each query's tokens that they hold, best ten."""
    x = table(spark, d, "conversation_messages", "conversation_message_row_id", "content").dropDuplicates().withColumnRenamed("conversation_message_row_id", "row_id")
    return r.coverage_top(x, "row_id", "content", table(spark, d, "eval_items", "item_id", "query"), "item_id", "query", rq.K)


def u02_scope_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Principals of a tenant that have both events and facts."""
    pair = lambda t: table(spark, d, t, "tenant_id", "principal_id")
    return pair("memory_events").intersect(pair("fact_items"))


def u07_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Per component of facts with a shared claim or text: its size and the member with most entities (ties: smallest id)."""
    c = texts.u06_components(spark, d)
    all_ = c.unionByName(c.select(F.col("component").alias("fact_id"), "component").dropDuplicates())
    f = table(spark, d, "fact_items", "fact_id", "entity_ids").groupBy("fact_id").agg(F.max(F.coalesce(F.size("entity_ids"), F.lit(0))).alias("n"))
    return all_.join(f, "fact_id").groupBy("component").agg(F.count("*").alias("members"), F.min_by("fact_id", F.struct(-F.col("n"), "fact_id")).alias("representative"))


def u10_transitive_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the groups of facts that hang together through a session and type or an equal claim."""
    f = table(spark, d, "fact_items", "fact_id", "session_id", "fact_type", "normalized_claim")
    keys = [F.when(F.col("session_id").isNotNull(), F.concat_ws("|", F.lit("s"), "session_id", "fact_type")), F.when(F.trim("normalized_claim") != "", F.concat(F.lit("c"), F.sha2("normalized_claim", 256)))]
    x = components_by_keys(f.select("fact_id", F.explode(F.array(*keys)).alias("key")), "fact_id", "key")
    return x.groupBy("component").agg(F.count("*").alias("facts")).where("facts > 1")


def t11_canonical_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that are the same but for punctuation, articles and pronouns, with their spellings."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("normalized_claim"), r"[^a-z0-9 ]", " "), r"\b(the|a|an|i|you|he|she|it|we|they|its|their)\b", " "), " +", " "))
    x = table(spark, d, "fact_items", "fact_id", "normalized_claim").select(c.alias("claim"), "normalized_claim").where("claim <> ''")
    return x.groupBy("claim").agg(F.count_distinct("normalized_claim").alias("spellings"))


def d10_cutoff_series(spark: SparkSession, d: str) -> DataFrame:
    """Every daily cutoff at 23:00 local time from the first to the last event, with the events since the one before; days without any included."""
    x = table(spark, d, "memory_events", "event_id", "created_at").groupBy("event_id").agg(F.min("created_at").alias("at"))
    local = F.to_date(F.from_utc_timestamp("at", ZONE) + F.expr("INTERVAL 1 HOUR"))  # the local day whose cutoff comes next
    per = x.groupBy(local.alias("day")).agg(F.count("*").alias("n"))
    days = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    at = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr("INTERVAL 23 HOURS"), ZONE)
    return days.join(per, "day", "left").select(F.unix_micros(at).alias("cutoff_us"), F.coalesce("n", F.lit(0)).alias("n"))


def r01_clean_ids(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose list of facts changes when ids are trimmed, blanks and nulls dropped, repeats removed and the rest sorted."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("source_fact_ids", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    x = table(spark, d, "fusion_relations", "relation_id", "source_fact_ids").where("source_fact_ids IS NOT NULL").select("relation_id", F.size("source_fact_ids").alias("before"), F.concat_ws(",", ids).alias("ids"), F.size(ids).alias("after"))
    return x.where("before <> after").select("relation_id", "ids", "after")


def x07_pending(spark: SparkSession, d: str) -> DataFrame:
    """Per session: messages stored after its commit, and by how many seconds the last one lags."""
    s = table(spark, d, "conversation_sessions", "session_id", "committed_at")
    m = table(spark, d, "conversation_messages", "session_id", "conversation_message_row_id", "stored_at").dropDuplicates()
    x = m.join(s, "session_id").where("stored_at > committed_at")
    lag = F.floor(F.max(F.unix_micros("stored_at") - F.unix_micros("committed_at")) / 1_000_000)
    return x.groupBy("session_id").agg(F.count("*").alias("pending"), lag.alias("lag_s"))


def g03_fact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Facts merged by principal, type and claim: how many, their span, the strongest confidence and the highest version."""
    rank = F.when(F.col("confidence_level") == "low", 0).when(F.col("confidence_level") == "medium", 1).when(F.col("confidence_level") == "high", 2)
    x = table(spark, d, "fact_items", "fact_id", "principal_id", "fact_type", "normalized_claim", "observed_at", "confidence_level", "version").where("trim(normalized_claim) <> ''")
    g = x.groupBy("principal_id", "fact_type", "normalized_claim").agg(F.count_distinct("fact_id").alias("facts"), F.min(F.unix_micros("observed_at")).alias("first_us"), F.max(F.unix_micros("observed_at")).alias("last_us"), F.max(rank).alias("confidence"), F.max("version").alias("version"))
    return g


def g21_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings of Markdown texts, by document and level."""
    h = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6}) +[^\s]"), F.lit(1))
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(h).alias("h"))
    return x.groupBy("doc_id", F.length("h").alias("level")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        s06_document_validation, s15_snapshot, f07_refined_match, j04_owners_by_source, j14_evidence_lineage, a02_term_totals, a07_event_merge, a14_status_pivot, a15_window_stats, a21_session_summary, m12_route_signals, m23_evidence_score,
        u02_scope_intersection, u07_representatives, u10_transitive_groups, t11_canonical_claims, d10_cutoff_series, r01_clean_ids, x07_pending, g03_fact_upsert, g21_sections,
    )
}
_T = rq.TOKENS
_QT = f"list_distinct({_T.format('query')})"
SQL = {
    "s06_document_validation": r"""WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)```context-session\s*\n(.*?)\n```', 1) AS b FROM documents WHERE doc_type = 'session_file' AND text IS NOT NULL),
m AS (SELECT doc_id, unnest(from_json(json_extract(j, '$.messages'), '[{"role":"VARCHAR","content":"VARCHAR"}]')) AS m FROM (SELECT doc_id, unnest(b) AS j FROM x) WHERE json_valid(j))
SELECT doc_id, 'no_batch_id' AS code FROM x WHERE regexp_extract(text, '(?m)^batch_id:[ \t]*(\S+)', 1) = '' UNION ALL SELECT doc_id, 'no_session' FROM x WHERE len(b) = 0
UNION ALL SELECT DISTINCT doc_id, 'bad_json' FROM (SELECT doc_id, unnest(b) AS j FROM x) WHERE CASE WHEN json_valid(j) THEN (j->>'$.sessionId') IS NULL ELSE true END
UNION ALL SELECT DISTINCT doc_id, 'bad_role' FROM m WHERE coalesce(m.role NOT IN ('user', 'assistant', 'tool', 'system'), true) UNION ALL SELECT DISTINCT doc_id, 'empty_message' FROM m WHERE trim(coalesce(m.content, ''), ' ') = ''""",
    "s15_snapshot": " UNION ALL ".join(f"SELECT '{t}' AS layer, tenant_id, count(*) AS n FROM {t} GROUP BY 2" for t in ("memory_events", "conversation_sessions", "fact_items")),
    "f07_refined_match": f"""WITH r AS (SELECT TIMESTAMPTZ '{FROM}+00' AS f, TIMESTAMPTZ '{TO}+00' AS t), g AS (SELECT entity_id, min(valid_time_start) AS s, max(coalesce(valid_time_end, valid_time_start)) AS e, bool_or({_V}) AS one FROM timeline_facts, r WHERE valid_time_start IS NOT NULL GROUP BY 1)
SELECT entity_id FROM g, r WHERE one AND CASE WHEN e = s THEN s >= f AND s < t ELSE s < t AND e > f END""",
    "j04_owners_by_source": r"""WITH x AS (SELECT DISTINCT fact_id, unnest(entity_ids) AS e FROM fact_items) SELECT DISTINCT fact_id FROM x WHERE e IN (SELECT e FROM x WHERE TRY_CAST(regexp_extract(fact_id, '(\d+)$', 1) AS BIGINT) % 100 = 0)""",
    "j14_evidence_lineage": """WITH x AS (SELECT DISTINCT entity_id, t.fact_id, session_id FROM timeline_facts t JOIN fact_items f ON f.fact_id = t.fact_id), m AS (SELECT session_id, count(DISTINCT message_id) AS m FROM conversation_messages GROUP BY 1),
s AS (SELECT entity_id, count(*) AS sessions, coalesce(sum(m), 0)::BIGINT AS messages FROM (SELECT DISTINCT entity_id, session_id FROM x WHERE session_id IS NOT NULL) LEFT JOIN m USING (session_id) GROUP BY 1)
SELECT f.entity_id, facts, sessions, messages FROM (SELECT entity_id, count(DISTINCT fact_id) AS facts FROM x GROUP BY 1) f LEFT JOIN s USING (entity_id)""",
    "a02_term_totals": f"SELECT doc_id, len({_T.format('text')})::INT AS tokens, len(list_distinct({_T.format('text')}))::INT AS distinct_tokens FROM documents WHERE text IS NOT NULL",
    "a07_event_merge": """WITH x AS (SELECT event_id, principal_id, event_type, min(created_at) AS ts_ FROM memory_events GROUP BY 1, 2, 3)
SELECT principal_id, event_type, ((ts_ AT TIME ZONE 'UTC')::DATE - DATE '1970-01-01')::INT AS day, arg_max(event_id, (ts_, event_id)) AS event_id, count(*) AS n FROM x GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "a14_status_pivot": """SELECT fact_type, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'superseded') AS superseded, count(*) FILTER (WHERE status = 'conflicted') AS conflicted, count(*) FILTER (WHERE status = 'rejected') AS rejected
FROM (SELECT DISTINCT fact_id, fact_type, status FROM fact_items) GROUP BY 1""",
    "a15_window_stats": """WITH x AS (SELECT principal_id, event_id, max(created_at) AS ts_ FROM memory_events GROUP BY 1, 2)
SELECT principal_id, epoch_us(max(ts_)) AS at_us, arg_max(event_id, (ts_, event_id)) AS event_id, least(count(*), 100) AS n FROM x GROUP BY 1""",
    "a21_session_summary": "SELECT source_app, count(*) AS n, count(DISTINCT document_status) AS states, round(avg((temporal_mode IS NULL)::INT), 6) AS without_mode FROM conversation_sessions GROUP BY 1",
    "m12_route_signals": f"""SELECT item_id, CASE WHEN len({_QT}) > 0 THEN least(1.0::DOUBLE, len({_QT}) / 4) ELSE 0.2 END AS keyword, (CASE WHEN len(list_filter({_QT}, lambda w: length(w) > 1)) > 0 THEN 0.5 ELSE 0.2 END)::DOUBLE AS graph,
 (CASE WHEN len(list_filter({_QT}, lambda w: regexp_matches(w, '\\d{{4}}|today|recent'))) > 0 THEN 0.8 ELSE 0.3 END)::DOUBLE AS time FROM eval_items WHERE query IS NOT NULL""",
    "m23_evidence_score": f"""WITH q AS (SELECT item_id AS query_id, unnest({_QT}) AS token, len({_QT}) AS n FROM eval_items WHERE query IS NOT NULL), m AS (SELECT DISTINCT conversation_message_row_id AS row_id, unnest(list_distinct({_T.format("content")})) AS token FROM conversation_messages),
s AS (SELECT query_id, row_id, round(count(*) / any_value(n), 6) AS score FROM q JOIN m USING (token) GROUP BY 1, 2) {rq._rank("s", "row_id", rq.K)}""",
    "u02_scope_intersection": "SELECT tenant_id, principal_id FROM memory_events INTERSECT SELECT tenant_id, principal_id FROM fact_items",
    "u07_representatives": f"""WITH RECURSIVE {texts.SQL["u06_components"].split("WITH RECURSIVE ")[1].rsplit("SELECT fact_id, min(g)", 1)[0]}, a AS (SELECT fact_id, min(g) AS component FROM c GROUP BY 1), n AS (SELECT fact_id, max(coalesce(len(entity_ids), 0)) AS n FROM fact_items GROUP BY 1)
SELECT component, count(*) AS members, arg_min(fact_id, (-n, fact_id)) AS representative FROM a JOIN n USING (fact_id) GROUP BY 1""",
    "u10_transitive_groups": """WITH RECURSIVE k AS (SELECT DISTINCT fact_id, 's|' || session_id || '|' || fact_type AS key FROM fact_items WHERE session_id IS NOT NULL UNION SELECT fact_id, 'c' || normalized_claim FROM fact_items WHERE trim(normalized_claim) <> ''),
h AS (SELECT key, min(fact_id) AS hub FROM k GROUP BY 1), e AS (SELECT DISTINCT hub AS a, fact_id AS b FROM k JOIN h USING (key) WHERE hub <> fact_id), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS fact_id, a AS g FROM w UNION SELECT w.b, c.g FROM c JOIN w ON w.a = c.fact_id), m AS (SELECT fact_id, min(g) AS component FROM c GROUP BY 1) SELECT component, count(*) AS facts FROM m GROUP BY 1""",
    "t11_canonical_claims": r"""WITH x AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(normalized_claim), '[^a-z0-9 ]', ' ', 'g'), '\b(the|a|an|i|you|he|she|it|we|they|its|their)\b', ' ', 'g'), ' +', ' ', 'g'), ' ') AS claim, normalized_claim FROM fact_items)
SELECT claim, count(DISTINCT normalized_claim) AS spellings FROM x WHERE claim <> '' GROUP BY 1""",
    "d10_cutoff_series": f"""WITH x AS (SELECT ((min(created_at) AT TIME ZONE '{ZONE}') + INTERVAL 1 HOUR)::DATE AS day FROM memory_events GROUP BY event_id), p AS (SELECT day, count(*) AS n FROM x GROUP BY 1), s AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM x)
SELECT epoch_us((s.day + INTERVAL 23 HOUR) AT TIME ZONE '{ZONE}') AS cutoff_us, coalesce(n, 0) AS n FROM s LEFT JOIN p ON p.day = s.day::DATE""",
    "r01_clean_ids": """WITH x AS (SELECT relation_id, len(source_fact_ids) AS before, list_sort(list_distinct(list_filter(list_transform(source_fact_ids, lambda x: trim(x, ' ')), lambda x: x IS NOT NULL AND x <> ''))) AS ids FROM fusion_relations WHERE source_fact_ids IS NOT NULL)
SELECT relation_id, array_to_string(ids, ',') AS ids, len(ids)::INT AS after FROM x WHERE before <> len(ids)""",
    "x07_pending": """SELECT session_id, count(DISTINCT conversation_message_row_id) AS pending, floor(max(epoch_us(stored_at) - epoch_us(committed_at)) / 1000000)::BIGINT AS lag_s FROM conversation_messages JOIN conversation_sessions USING (session_id) WHERE stored_at > committed_at GROUP BY 1""",
    "g03_fact_upsert": """SELECT principal_id, fact_type, normalized_claim, count(DISTINCT fact_id) AS facts, epoch_us(min(observed_at)) AS first_us, epoch_us(max(observed_at)) AS last_us, max(CASE confidence_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END) AS confidence, max(version) AS version
FROM fact_items WHERE trim(normalized_claim) <> '' GROUP BY 1, 2, 3""",
    "g21_sections": r"""SELECT doc_id, length(h)::INT AS level, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(#{1,6}) +[^\s]', 1)) AS h FROM documents) GROUP BY 1, 2""",
}
