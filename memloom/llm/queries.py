"""Queries of the problems tagged llm, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import contamination, conversations, encoding, grouping, near_duplicates, residue
from memloom.sources.tables import table

LINKING = ("same_event", "supplements", "updates")
SIMILAR = 0.75
FIELDS = ["fact_text", "normalized_claim"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = near_duplicates.similar_records(table(spark, d, "fact_items", "fact_id", *FIELDS), "fact_id", FIELDS, SIMILAR)
    return x.select(F.col("a").alias("fact_id_a"), F.col("b").alias("fact_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each fact that has a near-duplicate, with its group (facts joined directly or through others) and its number of links by field."""
    edges, links = near_duplicates.linked_records(table(spark, d, "fact_items", "fact_id", *FIELDS), "fact_id", FIELDS, SIMILAR)
    x = grouping.groups(edges, "a", "b").join(links.hint("merge"), F.col("vertex") == F.col("record"))
    return x.select(F.col("vertex").alias("fact_id"), "group_id", "links")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversation_messages")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = conversations.judge(table(spark, d, "conversation_sessions", "session_id"), _messages(spark, d))
    return x.where(F.size("reasons") > 0).select("session_id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    x = conversations.judge(table(spark, d, "conversation_sessions", "session_id"), _messages(spark, d))
    return x.select("session_id", F.explode("reasons").alias("reason"))


def p3_dialogue(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dialogue(table(spark, d, "conversation_sessions", "session_id"), _messages(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    relations = table(spark, d, "fusion_relations", "relation_id", "type", "source_fact_ids")
    pairs = grouping.relation_pairs(relations, table(spark, d, "fact_items", "fact_id"), LINKING)
    return grouping.groups(pairs, "a", "b").select(F.col("vertex").alias("fact_id"), "group_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(_documents(spark, d), "doc_id", "text")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked(_documents(spark, d), "doc_id", "text", _items(spark, d), "item_id", "passage")


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return contamination.reparameterised(_documents(spark, d), "doc_id", "text", _items(spark, d), "item_id", "passage")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_documents(spark, d), "doc_id", "text")


_P3 = r"""
WITH m AS (
  SELECT *, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS r, coalesce(operation <> 'delete', true) AS live,
         coalesce(regexp_matches(content, '\S'), false) AS filled, coalesce(status = 'completed', false) AS done
  FROM conversation_messages
  QUALIFY row_number() OVER (PARTITION BY session_id, message_id ORDER BY revision DESC, stored_at DESC, conversation_message_row_id DESC) = 1
), s AS (
  SELECT session_id, min(sequence) <> 1 OR max(sequence) <> count(*) OR count(sequence) <> count(*) OR count(DISTINCT sequence) <> count(*) AS broken,
         count(*) FILTER (WHERE live AND filled) = 0 AS no_content, count(*) FILTER (WHERE live AND r = 'user') = 0 AS no_user,
         count(*) FILTER (WHERE live AND coalesce(r NOT IN ('user', 'assistant', 'tool', 'system'), true)) > 0 AS strange
  FROM m GROUP BY session_id
), t AS (
  SELECT session_id, r, lead(r) OVER (PARTITION BY session_id ORDER BY sequence, message_id) AS nxt
  FROM m WHERE live AND sequence IS NOT NULL AND (r = 'user' OR (r = 'assistant' AND done AND filled))
), u AS (SELECT DISTINCT session_id FROM t WHERE r = 'user' AND coalesce(nxt = 'user', true)
), l AS (
  SELECT DISTINCT a.session_id FROM m a WHERE a.live AND a.reply_to_message_id IS NOT NULL
   AND NOT EXISTS (SELECT 1 FROM m b WHERE b.session_id = a.session_id AND b.message_id = a.reply_to_message_id)
), f AS (
  SELECT c.session_id, coalesce(s.broken, s.session_id IS NOT NULL) AS broken_sequence, coalesce(s.no_content, true) AS no_content, coalesce(s.no_user, true) AS no_user,
         coalesce(s.strange, false) AS unknown_role, l.session_id IS NOT NULL AS unknown_reply, u.session_id IS NOT NULL AS missing_answer
  FROM (SELECT DISTINCT session_id FROM conversation_sessions) c LEFT JOIN s USING (session_id) LEFT JOIN u ON u.session_id = c.session_id LEFT JOIN l ON l.session_id = c.session_id
)"""
_P3_ANY = "broken_sequence OR no_content OR no_user OR unknown_role OR unknown_reply OR missing_answer"

QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_reasons": p3_reasons, "p3_dialogue": p3_dialogue, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_reparameterised": p7_reparameterised, "p8_found": p8_found}
SQL = {
    "p3_found": _P3 + f" SELECT session_id FROM f WHERE {_P3_ANY}",
    "p3_reasons": _P3 + " SELECT session_id, reason FROM (UNPIVOT f ON broken_sequence, no_content, no_user, unknown_role, unknown_reply, missing_answer INTO NAME reason VALUE yes) WHERE yes",
    "p3_dialogue": _P3 + f" SELECT session_id, sequence, message_id, r AS role, content FROM m WHERE live AND session_id IN (SELECT session_id FROM f WHERE NOT ({_P3_ANY}))",
    "p5_found": r"""
WITH RECURSIVE k AS (SELECT lower(trim(fact_id)) AS k, min(fact_id) AS fact FROM fact_items GROUP BY 1
), n AS (
  SELECT relation_id, unnest(list_distinct(list_transform(source_fact_ids, lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))))) AS k
  FROM fusion_relations WHERE lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) IN ('same_event', 'supplements', 'updates')
), v AS (SELECT relation_id, fact FROM n JOIN k USING (k)
), h AS (SELECT relation_id, min(fact) AS hub FROM v GROUP BY 1
), e AS (SELECT DISTINCT hub AS a, fact AS b FROM v JOIN h USING (relation_id) WHERE fact <> hub
), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), c AS (SELECT DISTINCT a AS fact_id, a AS g FROM w UNION SELECT w.b, c.g FROM c JOIN w ON w.a = c.fact_id)
SELECT fact_id, min(g) AS group_id FROM c GROUP BY fact_id""",
}
