"""Retrieval queries: document frequencies, keyword, BM25 and vector rankings of whole query sets, fusion, metrics, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions.text import SPACES, squash
from memloom.operators import retrieval as r
from memloom.session import cut
from memloom.sources.tables import table

K = 10
COARSE = 100
KS = [1, 5, 10]


def _docs(spark, d):
    return table(spark, d, "documents", "doc_id", "text")


def _asked(spark, d):
    return table(spark, d, "eval_items", "item_id", "query")


def _probes(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding", "label").where("vec_id % 100 = 0")


def a03_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return r.document_frequency(_docs(spark, d), "text")


def _keyword(spark, d, k):
    return r.keyword_top(_docs(spark, d), "doc_id", "text", _asked(spark, d), "item_id", "query", k)


def _bm25(spark, d, k):
    return r.bm25_top(_docs(spark, d), "doc_id", "text", _asked(spark, d), "item_id", "query", k)


def m03_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, K)


def m05_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, K)


def w03_m04_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The two rankings (their best 100) fused by reciprocal rank."""
    x = r.fuse([_keyword(spark, d, COARSE), _bm25(spark, d, COARSE)], "doc_id")
    return r.ranked(x, "query_id", [F.desc("rrf"), F.col("doc_id")], K)


def m06_hybrid_final(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search: coarse lists, fusion, final score with recency and term overlap, one result per content, best 10."""
    lists = [cut(_keyword(spark, d, COARSE)), cut(_bm25(spark, d, COARSE))]  # a hundred rows for each query, read more than once
    fused = r.fuse(lists, "doc_id").join(lists[0].select("query_id", "doc_id", F.col("score").alias("keyword")), ["query_id", "doc_id"], "left")
    docs = table(spark, d, "documents", "doc_id", "text", "created_at")
    asked = _asked(spark, d).select(F.col("item_id").alias("query_id"), F.array_distinct(sc.tokens(F.col("query"))).alias("_q"))
    ids = fused.select("doc_id").dropDuplicates()
    found = docs.join(ids, "doc_id", "left_semi").select("doc_id", "created_at", r.content_key(F.col("text"), F.col("doc_id")).alias("_content"), F.array_distinct(sc.tokens(F.col("text"))).alias("_t"))
    x = fused.join(found, "doc_id").join(asked, "query_id")
    overlap = F.least(F.lit(1.0), F.lit(0.3) + F.lit(0.7) * F.size(F.array_intersect("_q", "_t")) / F.size("_q"))
    age = F.lit(AS_OF_S) - F.unix_micros("created_at") / 1e6
    x = x.withColumn("score", sc.final_score({"keyword": F.coalesce("keyword", F.lit(0.0)), "recency": sc.recency(age), "diversity": overlap, "rrf": F.col("rrf"), "staleness": sc.staleness(age)}))
    order = [F.desc("score"), F.col("doc_id")]
    once = x.withColumn("_first", F.row_number().over(r.Window.partitionBy("query_id", "_content").orderBy(*order))).where("_first = 1")
    return r.ranked(once, "query_id", order, K).select("query_id", "doc_id", "score", "rank")


AS_OF_S = 1_767_225_600  # 2026-01-01: scores take their present time as a parameter


def u03_shadow_diff(spark: SparkSession, d: str) -> DataFrame:
    """What the BM25 ranking adds to and takes from the keyword ranking."""
    a, b = cut(_keyword(spark, d, K).select("query_id", "doc_id")), cut(_bm25(spark, d, K).select("query_id", "doc_id"))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def m01_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    return r.vector_top(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _probes(spark, d), "vec_id", "embedding", K)


def _vector_metrics(spark, d):
    x = r.vector_top(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _probes(spark, d), "vec_id", "embedding", K + 1)
    x = r.ranked(x.where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("item"), "score"), "query_id", [F.desc("score"), F.col("item")], K)
    # Relevant are the vectors with the probe's label: the size of the label says how many, the labels of the results which.
    labels = table(spark, d, "embeddings", "vec_id", "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    probes = _probes(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("_asked"))
    x = x.join(probes, "query_id").join(labels.select(F.col("vec_id").alias("item"), "label"), "item").withColumn("hit", F.coalesce((F.col("label") == F.col("_asked")).cast("int"), F.lit(0)))
    gold = probes.join(sizes, F.col("_asked") == F.col("label")).where("gold > 0").select("query_id", "gold")
    return r.metrics_of_hits(x.select("query_id", "item", "rank", "hit"), gold, KS)


def a08_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _vector_metrics(spark, d)


def a09_macro_average(spark: SparkSession, d: str) -> DataFrame:
    names = ["recall", "precision", "mrr", "ndcg", "ndcg_alt"]
    return _vector_metrics(spark, d).groupBy("k").agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 4).alias(c) for c in names])


def u05_dedup_content(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose text, up to case and white space, an earlier document has, with that document."""
    x = _docs(spark, d).select("doc_id", r.content_key(F.col("text"), F.col("doc_id")).alias("c"))
    first = x.groupBy("c").agg(F.min("doc_id").alias("duplicate_of"))
    return x.join(first, "c").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


def u08_best_per_content(spark: SparkSession, d: str) -> DataFrame:
    """Per content: the longest document (ties: smallest id), how many share it, and their sources."""
    x = table(spark, d, "documents", "doc_id", "text", "source", "n_chars").where("text IS NOT NULL")
    x = x.withColumn("content", F.sha2(squash(F.col("text")), 256))
    best = F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id"))
    g = x.groupBy("content").agg(best.alias("doc_id"), F.count("*").alias("copies"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))
    return g.where("copies > 1").select("content", "doc_id", "copies", "sources")


def m22_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic embedding: tokens hashed (h = 31 h + letter, 32 bits) into 64 buckets, normed; as rows (doc_id, bucket, weight)."""
    h = lambda w: F.aggregate(F.transform(F.split(w, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32)) % 64
    x = _docs(spark, d).select("doc_id", F.explode(sc.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    x = x.groupBy("doc_id", h(F.col("w")).alias("bucket")).agg(F.sum("n").alias("n"))
    norm = x.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("l"))
    return x.join(norm, "doc_id").select("doc_id", "bucket", F.round(F.col("n") / F.col("l"), 6).alias("weight"))


def p02_fact_search(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation queries against all facts by keyword, with the fact's current row (highest version) joined back."""
    facts = table(spark, d, "fact_items", "fact_id", "version", "fact_type", "fact_text")
    now = facts.groupBy("fact_id").agg(F.max_by(F.struct("fact_type", "fact_text"), F.struct("version", "fact_text")).alias("f")).select("fact_id", "f.*")
    hits = r.keyword_top(now, "fact_id", "fact_text", _asked(spark, d), "item_id", "query", K)
    return hits.join(now.select("fact_id", "fact_type"), "fact_id").select("query_id", "fact_id", "fact_type", "score", "rank")


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) >= 6 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) WHEN length({w}) >= 5 AND {w} LIKE '%ied' THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN length({w}) >= 5 AND {w} LIKE '%sed' THEN left({w}, length({w}) - 1) WHEN length({w}) >= 5 AND {w} LIKE '%ed' THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) >= 5 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) >= 4 AND {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def _keyword_sql(rows: str, key: str) -> str:
    """CTEs up to kw(query_id, key, score) over rows(key, text)."""
    same = " OR ".join(f"(w.token = '{a}' AND t.token = '{b}') OR (w.token = '{b}' AND t.token = '{a}')" for a, b in sc.SYNONYMS)
    return f"""
rows_ AS ({rows}), t AS (SELECT DISTINCT {key}, unnest({TOKENS.format("text")}) AS token FROM rows_),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("query")}) AS token FROM eval_items),
f AS (SELECT token, count(*) AS df FROM t GROUP BY token), n AS (SELECT count(*) AS n FROM rows_),
w AS (SELECT query_id, q.token, ln((n.n + 1) / (coalesce(f.df, 0) + 1)) + 1 AS weight FROM q CROSS JOIN n LEFT JOIN f ON f.token = q.token),
total AS (SELECT query_id, sum(weight) AS total FROM w GROUP BY 1),
ex AS (SELECT query_id, {key}, w.token, weight FROM w JOIN t ON t.token = w.token),
nr AS (SELECT DISTINCT query_id, {key}, w.token, weight FROM w JOIN t ON {_stem("t.token")} = {_stem("w.token")}
       UNION SELECT DISTINCT query_id, {key}, w.token, weight FROM w JOIN t ON {same}),
al AS (SELECT query_id, {key}, token, weight, 0.7 AS f FROM ex UNION ALL SELECT query_id, {key}, token, weight, 0.3 FROM nr ANTI JOIN ex USING (query_id, {key}, token)),
kw AS (SELECT query_id, {key}, round(sum(weight * f) / any_value(total), 6) AS score FROM al JOIN total USING (query_id) GROUP BY 1, 2)"""


_DOCS = "SELECT doc_id, text FROM documents"
_BM = f"""
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS token FROM documents) GROUP BY 1, 2),
len AS (SELECT doc_id, coalesce(len({TOKENS.format("text")}), 0) AS l FROM documents), mean AS (SELECT avg(l) AS m, count(*) AS n FROM len),
bf AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), bq AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("query")}) AS token FROM eval_items),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score
       FROM bq JOIN tf USING (token) JOIN bf USING (token) JOIN len USING (doc_id) CROSS JOIN mean GROUP BY 1, 2)"""


def _rank(rel: str, key: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key})::INT AS rank{extra} FROM {rel} WHERE score > 0 QUALIFY rank <= {k}"


_LISTS = f"WITH {_keyword_sql(_DOCS, 'doc_id')}, {_BM}, k1 AS ({_rank('kw', 'doc_id', COARSE)}), b1 AS ({_rank('bm', 'doc_id', COARSE)})"
_RRF = _LISTS + ", rf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT * FROM k1 UNION ALL SELECT * FROM b1) GROUP BY 1, 2)"
_SQUASH = f"trim(regexp_replace(lower(text), '{SPACES}', ' ', 'g'), ' ')"
_COS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.e, b.e), 5) AS score FROM v a, v b WHERE a.vec_id % 100 = 0)"""
_METRICS = (
    _COS
    + f"""
, top AS (SELECT query_id, vec_id, (la = lb)::INT AS hit, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r0 FROM s QUALIFY r0 <= {K + 1})
, res AS (SELECT query_id, hit, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank FROM top WHERE query_id <> vec_id QUALIFY rank <= {K})
, rel AS (SELECT query_id, sum(hit) AS relevant FROM res GROUP BY 1)
, gold AS (SELECT query_id, count(*) AS gold FROM s WHERE la = lb AND query_id <> vec_id GROUP BY 1)
, g AS (SELECT query_id, k, sum(hit) AS hits, count(*) AS n, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit / log2(rank + 1)) AS dcg,
          sum(hit / CASE WHEN rank = 1 THEN 1.0 ELSE log2(greatest(rank, 2)) END) AS dcg_alt FROM res, (SELECT unnest({KS}) AS k) WHERE rank <= k GROUP BY 1, 2)
, m AS (SELECT query_id, k::INT AS k, round(hits / gold, 6) AS recall, (hits > 0)::INT AS recall_any, (hits = gold)::INT AS recall_all, round(hits / n, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
     round(CASE WHEN relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(relevant, n)::INT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg,
     round(dcg_alt / list_sum(list_transform(range(1, least(gold, n)::INT + 1), lambda i: 1 / CASE WHEN i = 1 THEN 1.0 ELSE log2(greatest(i, 2)) END)), 6) AS ndcg_alt
   FROM g JOIN gold USING (query_id) JOIN rel USING (query_id))"""
)
_AGE = f"({AS_OF_S} - epoch_us(created_at) / 1e6)"

QUERIES = {f.__name__: f for f in (a03_document_frequency, m03_keyword_score, m05_bm25, w03_m04_rrf, m06_hybrid_final, u03_shadow_diff, m01_cosine_topk, a08_ranking_metrics, a09_macro_average, u05_dedup_content, u08_best_per_content, m22_hash_embedding, p02_fact_search)}
SQL = {
    "a03_document_frequency": f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token",
    "m03_keyword_score": f"WITH {_keyword_sql(_DOCS, 'doc_id')} {_rank('kw', 'doc_id', K)}",
    "m05_bm25": f"WITH {_BM} {_rank('bm', 'doc_id', K)}",
    "w03_m04_rrf": _RRF + f" SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id)::INT AS rank FROM rf QUALIFY rank <= {K}",
    "m06_hybrid_final": _RRF
    + f""", x AS (SELECT rf.query_id, rf.doc_id, CASE WHEN coalesce({_SQUASH}, '') = '' THEN 'id:' || rf.doc_id ELSE sha256({_SQUASH}) END AS c,
  round(0.18 * coalesce(k1.score, 0) + 0.06 * (CASE WHEN {_AGE} IS NULL THEN 0.2 WHEN abs({_AGE}) < 3600 THEN 1.0 WHEN abs({_AGE}) < 86400 THEN 0.8 WHEN abs({_AGE}) < 604800 THEN 0.6 ELSE 0.3 END)::DOUBLE
    + 0.04 * least(1.0::DOUBLE, 0.3::DOUBLE + 0.7::DOUBLE * len(list_intersect(list_distinct({TOKENS.format("query")}), list_distinct({TOKENS.format("text")}))) / len(list_distinct({TOKENS.format("query")}))) + 0.08 * rrf
    - 0.08 * (CASE WHEN {_AGE} IS NULL THEN 0.2 WHEN {_AGE} < 604800 THEN 0 WHEN {_AGE} < 2592000 THEN 0.2 ELSE 0.5 END)::DOUBLE, 6) AS score
  FROM rf JOIN documents USING (doc_id) JOIN eval_items ON item_id = rf.query_id LEFT JOIN k1 ON k1.query_id = rf.query_id AND k1.doc_id = rf.doc_id)
, o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, doc_id) = 1)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM o QUALIFY rank <= {K}""",
    "u03_shadow_diff": f"""WITH {_keyword_sql(_DOCS, "doc_id")}, {_BM}, a AS (SELECT query_id, doc_id FROM ({_rank("kw", "doc_id", K)})), b AS (SELECT query_id, doc_id FROM ({_rank("bm", "doc_id", K)}))
SELECT *, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)""",
    "m01_cosine_topk": _COS + f" SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= {K}",
    "a08_ranking_metrics": _METRICS + " SELECT * FROM m",
    "a09_macro_average": _METRICS + " SELECT k, count(*) AS cases, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(ndcg_alt), 4) AS ndcg_alt FROM m GROUP BY k",
    "u05_dedup_content": f"SELECT doc_id, duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_SQUASH}) AS duplicate_of FROM documents WHERE coalesce({_SQUASH}, '') <> '') WHERE doc_id <> duplicate_of",
    "u08_best_per_content": f"""SELECT content, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM (SELECT *, sha256({_SQUASH}) AS content FROM documents WHERE text IS NOT NULL) GROUP BY content HAVING count(*) > 1""",
    "m22_hash_embedding": f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS w FROM documents), d AS (SELECT DISTINCT w FROM t),
h AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) % 64 AS bucket FROM d),
n AS (SELECT doc_id, bucket, count(*) AS n FROM t JOIN h USING (w) GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM n""",
    "p02_fact_search": f"""WITH now AS (SELECT * FROM fact_items QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY version DESC, fact_text DESC) = 1),
{_keyword_sql("SELECT fact_id, fact_text AS text FROM now", "fact_id")} SELECT query_id, fact_id, fact_type, score, rank FROM ({_rank("kw", "fact_id", K)}) JOIN now USING (fact_id)""",
}
