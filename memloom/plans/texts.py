"""Text, source and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions.text import SPACES, squash
from memloom.operators.chunks import chunks
from memloom.operators.components import components_by_keys
from memloom.operators.packing import select_within_budget
from memloom.plans import retrieval as r
from memloom.session import cut
from memloom.sources import formats
from memloom.sources.tables import table

BUDGET = 2000
ARTICLES = ("a", "an", "the", "and")


def _docs(spark, d, *more):
    return table(spark, d, "documents", "doc_id", "text", *more)


def t01_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids, squashed length and preview of every text."""
    x = _docs(spark, d).where("text IS NOT NULL").withColumn("s", squash(F.col("text")))
    return x.select("doc_id", F.substring(F.sha2("s", 256), 1, 24).alias("content_id"), F.length("s").alias("n"), F.substring("s", 1, 120).alias("preview"))


def t05_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the corpus with the number of forms and of documents."""
    x = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(sc.tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return x.groupBy(sc.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("forms"), F.sum("df").alias("uses")).where("forms > 1")


def t10_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", sc.token_estimate(F.col("text")).alias("tokens"))


def t17_cjk_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each pair of neighbouring Han characters occurs."""
    runs = F.regexp_extract_all("text", F.lit("[一-鿿]{2,}"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))))
    return _docs(spark, d).select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def t22_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of at most 200 estimated tokens, cut at paragraphs and sentences."""
    return chunks(_docs(spark, d), "doc_id", "text", 200)


def f16_quantitative(spark: SparkSession, d: str) -> DataFrame:
    """Facts that state a number with a unit, an amount of money or a date, and are neither questions nor suppositions."""
    f = table(spark, d, "fact_items", "fact_id", "fact_text", "confidence_level").dropDuplicates()
    t = F.lower("fact_text")
    value = t.rlike(r"[$€£¥] ?\d|\d+([.,]\d+)? ?(%|percent|euros?|dollars?|usd|eur|days?|weeks?|months?|years?|hours?|minutes?)\b|\b(19|20)\d\d\b|\d{1,2}:\d{2}")
    question = t.rlike(r"\?\s*$") & t.rlike(r"^(what|when|where|who|why|how|is|are|do|does|did|can|could|would|should)\b")
    return f.where(value & ~question & ~t.rlike(r"\b(suppose|hypothetical|for example)\b") & (F.coalesce("confidence_level", F.lit("")) != "low")).select("fact_id").dropDuplicates()


def f21_missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a fact's text that its claim has lost."""
    f = table(spark, d, "fact_items", "fact_id", "fact_text", "normalized_claim").dropDuplicates()
    numbers = lambda c: F.coalesce(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), F.array().cast("array<string>"))
    return f.select("fact_id", F.explode(F.array_except(numbers("fact_text"), numbers("normalized_claim"))).alias("number")).dropDuplicates()


def t18_lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of a fact's text its claim keeps: shared tokens over the root of both sizes."""
    f = table(spark, d, "fact_items", "fact_id", "fact_text", "normalized_claim").dropDuplicates(["fact_id", "fact_text", "normalized_claim"])
    a, b = F.array_distinct(sc.tokens(F.col("fact_text"))), F.array_distinct(sc.tokens(F.col("normalized_claim")))
    x = f.where((F.size(a) > 0) & (F.size(b) > 0)).select("fact_id", F.round(F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double")), 6).alias("overlap"))
    return x.groupBy("fact_id").agg(F.min("overlap").alias("overlap"))


def _answer_tokens(c):
    plain = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))


def _f1(spark, d):
    """Token F1 of every item's query against its passage."""
    e = table(spark, d, "eval_items", "item_id", "category", "query", "passage").where("query IS NOT NULL AND passage IS NOT NULL")
    count = lambda c, n: e.select("item_id", F.explode(_answer_tokens(F.col(c))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias(n))
    both = count("query", "p").join(count("passage", "g"), ["item_id", "w"], "full")
    x = both.groupBy("item_id").agg(F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0)))).alias("o"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    f1 = F.when(F.col("o") > 0, 2 * F.col("o") / (F.col("p") + F.col("g"))).otherwise(0.0)
    return e.select("item_id", "category").join(x, "item_id").select("item_id", "category", F.round(f1, 3).alias("f1"))


def a11_token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _f1(spark, d)


def a12_category_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by category and, with a null category, over all."""
    return _f1(spark, d).rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("score"), F.round(F.avg((F.col("f1") == 1).cast("double")), 6).alias("perfect"))


def a17_citations(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, characters, and its three earliest documents."""
    x = table(spark, d, "documents", "doc_id", "source", "n_chars", "created_at")
    w = Window.partitionBy("source").orderBy("created_at", "doc_id")
    first = x.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("source").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("k", "doc_id"))), lambda s: s["doc_id"].cast("string"))).alias("first"))
    return x.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).join(first, "source")


def w07_budget_select(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 ranking of each query packed into a budget of tokens."""
    ranked = r._bm25(spark, d, r.COARSE)
    ranked = cut(ranked)
    cost = _docs(spark, d).join(ranked.select("doc_id").dropDuplicates(), "doc_id", "left_semi").select("doc_id", sc.token_estimate(F.col("text")).alias("cost"))
    x = select_within_budget(ranked.join(cost, "doc_id"), "query_id", "rank", "doc_id", "cost", BUDGET, r.COARSE)
    return x.select("query_id", F.col("item").alias("doc_id"), "used")


def u06_components(spark: SparkSession, d: str) -> DataFrame:
    """Facts that belong together because they share a claim or a text: (fact_id, component)."""
    f = table(spark, d, "fact_items", "fact_id", "fact_text", "normalized_claim")
    keys = [F.when(squash(F.col(c)) != "", F.concat(F.lit(p), F.sha2(squash(F.col(c)), 256))) for c, p in (("fact_text", "t"), ("normalized_claim", "c"))]
    x = components_by_keys(f.select("fact_id", F.explode(F.array(*keys)).alias("key")), "fact_id", "key")
    return x.where("item <> component").select(F.col("item").alias("fact_id"), "component")


def s05_session_files(spark: SparkSession, d: str) -> DataFrame:
    x = formats.session_messages(_docs(spark, d, "doc_type").where("doc_type = 'session_file'"), "doc_id", "text")
    return x.groupBy("doc_id", "batch_id", "session_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("users"), F.sum(F.length("content")).alias("chars"))


def s07_fact_tables(spark: SparkSession, d: str) -> DataFrame:
    return formats.fact_rows(_docs(spark, d), "doc_id", "text")


_T = r.TOKENS
_SQ = r._SQUASH
_ANS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and'))"
_EST = f"(SELECT doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)"
_COST = r"""(CASE WHEN t = '' THEN 0 ELSE greatest(1, ceil(coalesce(list_sum(list_transform(regexp_extract_all(t, '[A-Za-z0-9_]+'), lambda w: ceil(length(w) / 4))), 0)
 + length(regexp_replace(t, '[^\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g')) + length(regexp_replace(t, '[\x00-\x7F\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g'))
 + length(regexp_replace(t, '[\sA-Za-z0-9_\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g')) * 0.5)) END)::INT"""
_F1 = f"""WITH e AS (SELECT * FROM eval_items WHERE query IS NOT NULL AND passage IS NOT NULL), p AS (SELECT item_id, w, count(*) AS p FROM (SELECT item_id, unnest({_ANS.format("query")}) AS w FROM e) GROUP BY 1, 2),
g AS (SELECT item_id, w, count(*) AS g FROM (SELECT item_id, unnest({_ANS.format("passage")}) AS w FROM e) GROUP BY 1, 2),
x AS (SELECT item_id, sum(least(coalesce(p, 0), coalesce(g, 0))) AS o, sum(p) AS p, sum(g) AS g FROM p FULL JOIN g USING (item_id, w) GROUP BY 1),
s AS (SELECT item_id, category, round(CASE WHEN o > 0 THEN 2 * o / (p + g) ELSE 0 END, 3) AS f1 FROM e JOIN x USING (item_id))"""

QUERIES = {
    f.__name__: f
    for f in (t01_normalised, t05_stems, t10_token_estimate, t17_cjk_bigrams, t22_chunks, f16_quantitative, f21_missing_numbers, t18_lexical_overlap, a11_token_f1, a12_category_scores, a17_citations, w07_budget_select, u06_components, s05_session_files, s07_fact_tables)
}
SQL = {
    "t01_normalised": f"SELECT doc_id, left(sha256({_SQ}), 24) AS content_id, length({_SQ})::INT AS n, left({_SQ}, 120) AS preview FROM documents WHERE text IS NOT NULL",
    "t05_stems": f"""WITH w AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_T.format("text")}) AS w FROM documents) GROUP BY 1)
SELECT {r._stem("w")} AS stem, count(*) AS forms, sum(df)::BIGINT AS uses FROM w GROUP BY 1 HAVING count(*) > 1""",
    "t10_token_estimate": f"SELECT doc_id, {_COST} AS tokens FROM {_EST}",
    "t17_cjk_bigrams": "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[一-鿿]{2,}')) AS s FROM documents) SELECT gram, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS gram FROM s) GROUP BY 1",
    "f16_quantitative": r"""SELECT DISTINCT fact_id FROM fact_items WHERE regexp_matches(lower(fact_text), '[$€£¥] ?\d|\d+([.,]\d+)? ?(%|percent|euros?|dollars?|usd|eur|days?|weeks?|months?|years?|hours?|minutes?)\b|\b(19|20)\d\d\b|\d{1,2}:\d{2}')
 AND NOT (regexp_matches(lower(fact_text), '\?\s*$') AND regexp_matches(lower(fact_text), '^(what|when|where|who|why|how|is|are|do|does|did|can|could|would|should)\b')) AND NOT regexp_matches(lower(fact_text), '\b(suppose|hypothetical|for example)\b') AND coalesce(confidence_level, '') <> 'low'""",
    "f21_missing_numbers": r"SELECT DISTINCT fact_id, number FROM (SELECT fact_id, normalized_claim, unnest(regexp_extract_all(fact_text, '\d+')) AS number FROM fact_items) WHERE NOT list_contains(coalesce(regexp_extract_all(normalized_claim, '\d+'), []), number)",
    "t18_lexical_overlap": f"""WITH x AS (SELECT fact_id, list_distinct({_T.format("fact_text")}) AS a, list_distinct({_T.format("normalized_claim")}) AS b FROM fact_items)
SELECT fact_id, min(round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6)) AS overlap FROM x WHERE len(a) > 0 AND len(b) > 0 GROUP BY 1""",
    "a11_token_f1": _F1 + " SELECT * FROM s",
    "a12_category_scores": _F1 + " SELECT category, count(*) AS n, round(avg(f1), 6) AS score, round(avg((f1 = 1)::INT), 6) AS perfect FROM s GROUP BY ROLLUP (category)",
    "a17_citations": """WITH f AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY created_at, doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY 1)
SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, any_value(first) AS first FROM documents JOIN f USING (source) GROUP BY 1""",
    "w07_budget_select": f"""WITH RECURSIVE {r._BM}, k AS ({r._rank("bm", "doc_id", r.COARSE)}), c AS (SELECT query_id, rank, doc_id, {_COST}::BIGINT AS cost FROM k JOIN {_EST} USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM c),
s AS (SELECT query_id, n, doc_id, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS used, cost <= {BUDGET} AS taken FROM o WHERE n = 1
 UNION ALL SELECT o.query_id, o.n, o.doc_id, s.used + CASE WHEN s.used + o.cost <= {BUDGET} THEN o.cost ELSE 0 END, s.used + o.cost <= {BUDGET} FROM s JOIN o ON o.query_id = s.query_id AND o.n = s.n + 1)
SELECT query_id, doc_id, used FROM s WHERE taken""",
    "u06_components": r"""WITH RECURSIVE k AS (SELECT DISTINCT fact_id, 't' || trim(regexp_replace(lower(fact_text), '\s+', ' ', 'g')) AS key FROM fact_items UNION SELECT fact_id, 'c' || trim(regexp_replace(lower(normalized_claim), '\s+', ' ', 'g')) FROM fact_items),
v AS (SELECT * FROM k WHERE length(key) > 1), h AS (SELECT key, min(fact_id) AS hub FROM v GROUP BY 1), e AS (SELECT DISTINCT hub AS a, fact_id AS b FROM v JOIN h USING (key) WHERE hub <> fact_id),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS fact_id, a AS g FROM w UNION SELECT w.b, c.g FROM c JOIN w ON w.a = c.fact_id)
SELECT fact_id, min(g) AS component FROM c GROUP BY 1 HAVING min(g) <> fact_id""",
    "s05_session_files": r"""WITH b AS (SELECT doc_id, regexp_extract(text, '(?m)^batch_id:[ \t]*(\S+)', 1) AS batch_id, unnest(regexp_extract_all(text, '(?s)```context-session\s*\n(.*?)\n```', 1)) AS j FROM documents WHERE doc_type = 'session_file'),
s AS (SELECT doc_id, batch_id, j->>'$.sessionId' AS session_id, unnest(from_json(json_extract(j, '$.messages'), '[{"role":"VARCHAR","content":"VARCHAR"}]')) AS m FROM b WHERE json_valid(j))
SELECT doc_id, batch_id, session_id, count(*) AS messages, count(*) FILTER (WHERE m.role = 'user') AS users, sum(length(m.content))::BIGINT AS chars FROM s GROUP BY 1, 2, 3""",
    "s07_fact_tables": r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS l, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 AS line FROM documents WHERE contains(text, '| factText | factType |')),
c AS (SELECT doc_id, line, string_split(regexp_replace(trim(l), '^\||\|$', '', 'g'), '|') AS c FROM l WHERE regexp_matches(l, '^\|.*\|\s*$') AND NOT regexp_matches(l, '^\|\s*(factText\s*\||-{3})'))
SELECT doc_id, line::INT AS line, trim(c[1]) AS fact_text, trim(c[2]) AS fact_type, trim(c[3]) AS confidence FROM c WHERE len(c) >= 2""",
}
