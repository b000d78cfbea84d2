"""Many queries against a corpus: keyword and BM25 scores, exact vector search, rank fusion, deduplication, ranking metrics."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions.text import squash
from memloom.operators.blocks import best_in_blocks, query_blocks, united

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """Rows (token, df): in how many rows each token occurs. Null texts hold none."""
    return df.select(F.explode(F.array_distinct(sc.tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def query_tokens(queries: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (query_id, token), distinct."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(sc.tokens(F.col(text)))).alias("token")).dropDuplicates()


def _frequencies(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Document frequencies of the words of a bounded query set."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], "token string")
    return {r.token: r.df for r in document_frequency(df, text).join(F.broadcast(words), "token", "left_semi").collect()}


def _asked(queries: DataFrame, key: str, text: str) -> DataFrame:
    """The queries that have a token: (q, t)."""
    tokens = F.array_sort(F.array_distinct(sc.tokens(F.col(text))))
    return queries.select(F.col(key).alias("q"), tokens.alias("t")).where("t IS NOT NULL AND size(t) > 0")


class Shares:
    """What each word of a block of queries weighs in each query, kept by word and query."""

    def __init__(self, asked: list[list[str]], words: list[str], weight: np.ndarray, whole: bool):
        at = {w: i for i, w in enumerate(words)}
        self.query = np.repeat(np.arange(len(asked)), [len(t) for t in asked])
        self.word = np.array([at[w] for t in asked for w in t], np.int64)
        self.share = weight[self.word].astype(float)
        if whole:  # of the query's total
            self.share /= np.bincount(self.query, self.share, len(asked))[self.query]
        self.words, self.queries = len(words), len(asked)

    def part(self, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """The words of some queries, and their shares as a matrix of words and queries."""
        first, last, _ = some.indices(self.queries)
        lo, hi = np.searchsorted(self.query, (first, last))
        words, place = np.unique(self.word[lo:hi], return_inverse=True)
        out = np.zeros((len(words), last - first))
        out[place, self.query[lo:hi] - first] = self.share[lo:hi]
        return words, out


def _hits(lists: pd.Series, words: pd.Index) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of token lists the rows and the places of their words (-1 for others), by one lookup of a whole column."""
    size = lists.str.len().fillna(0).to_numpy(int)
    flat = np.concatenate([t for t in lists if t is not None and len(t)]) if size.sum() else np.zeros(0, object)
    return np.repeat(np.arange(len(lists)), size), words.get_indexer(flat)


def _matrix(row: np.ndarray, word: np.ndarray, n: int, words: np.ndarray, all_words: int) -> np.ndarray:
    """n rows by words: how often each hits."""
    place = np.full(all_words + 1, -1)
    place[words] = np.arange(len(words))
    at = place[word]
    out = np.bincount(row[at >= 0] * len(words) + at[at >= 0], minlength=n * len(words))
    return out.reshape(n, len(words)).astype(float)


def keyword_top(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """Rows (query_id, key, score, rank): 0.7 x the IDF share of a query's tokens that a row holds + 0.3 x that of tokens it holds in another
    form (same stem, or a synonym). The corpus is read twice: for the frequencies of the query words, and for the scores."""
    n, found = df.count(), []
    for block in query_blocks(_asked(queries, query_key, query_text), "q"):
        asked = [list(t) for t in block["t"]]
        words = sorted({w for t in asked for w in t})
        freq, at = _frequencies(df, text, words), {w: i for i, w in enumerate(words)}
        shares = Shares(asked, words, np.array([np.log((n + 1) / (freq.get(w, 0) + 1)) + 1 for w in words]), True)
        forms = df.sparkSession.createDataFrame([(w,) for w in words], "w string").select("w", sc.stem(F.col("w")).alias("s"))
        near = [("s:" + r.s, at[r.w]) for r in forms.collect()] + [("t:" + w, at[o]) for pair in sc.SYNONYMS for w in pair for o in pair if o != w and o in at]
        found.append(_keyword_block(df, key, text, block["q"].tolist(), queries.schema[query_key].dataType.simpleString(), words, shares, near, k))
    return united(found, df, key, queries, query_key)


def _keyword_block(df: DataFrame, key: str, text: str, ids: list, query_kind: str, words: list[str], shares: Shares, near: list[tuple[str, int]], k: int) -> DataFrame:
    names = sorted({f for f, _ in near})
    place = {f: i for i, f in enumerate(names)}
    other = sorted((place[f], j) for f, j in near)
    form, target = np.array([f for f, _ in other], np.int64), np.array([j for _, j in other], np.int64)

    def score(batch: pd.DataFrame):  # noqa: ANN202
        index, forms = pd.Index(words), pd.Index(names)
        row, word = _hits(batch["_t"], index)
        near_row, near_form = _hits(batch["_f"], forms)
        near_row, near_form = near_row[near_form >= 0], near_form[near_form >= 0]
        lo, hi = np.searchsorted(form, near_form), np.searchsorted(form, near_form, "right")
        near_row, start, count = np.repeat(near_row, hi - lo), np.repeat(lo, hi - lo), hi - lo
        near_word = target[start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)] if len(start) else np.zeros(0, np.int64)

        def part(some: slice) -> np.ndarray:
            wanted, share = shares.part(some)
            exact = np.minimum(_matrix(row, word, len(batch), wanted, len(words)), 1)
            close = np.minimum(_matrix(near_row, near_word, len(batch), wanted, len(words)), 1)
            return 0.7 * exact @ share + 0.3 * np.where(exact > 0, 0, close) @ share

        return part

    tokens = F.array_distinct(sc.tokens(F.col(text)))
    rows = df.select(key, tokens.alias("_t"))
    rows = rows.withColumn("_f", F.concat(F.transform("_t", lambda w: F.concat(F.lit("t:"), w)), F.transform("_t", lambda w: F.concat(F.lit("s:"), sc.stem(w)))))
    return best_in_blocks(rows, key, df.schema[key].dataType.simpleString(), ids, query_kind, score, k, above=0.0)


def bm25_top(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows (query_id, key, score, rank) by BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    r, found = df.select(F.count("*").alias("n"), F.avg(F.coalesce(F.size(sc.tokens(F.col(text))), F.lit(0))).alias("mean")).first(), []
    mean = r.mean or 1.0
    for block in query_blocks(_asked(queries, query_key, query_text), "q"):
        asked = [list(t) for t in block["t"]]
        words = sorted({w for t in asked for w in t})
        freq = _frequencies(df, text, words)
        shares = Shares(asked, words, np.array([np.log(1 + (r.n - freq.get(w, 0) + 0.5) / (freq.get(w, 0) + 0.5)) for w in words]), False)

        def score(batch: pd.DataFrame, words=words, shares=shares):  # noqa: ANN001, ANN202
            row, word = _hits(batch["_t"], pd.Index(words))
            size = batch["_t"].str.len().fillna(0).to_numpy(float)[:, None]

            def part(some: slice) -> np.ndarray:
                wanted, share = shares.part(some)
                tf = _matrix(row, word, len(batch), wanted, len(words))
                return (tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))) @ share

            return part

        rows = df.select(key, sc.tokens(F.col(text)).alias("_t"))
        found.append(best_in_blocks(rows, key, df.schema[key].dataType.simpleString(), block["q"].tolist(), queries.schema[query_key].dataType.simpleString(), score, k, above=0.0))
    return united(found, df, key, queries, query_key)


def coverage_top(df: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """Rows (query_id, key, score, rank) by the share of a query's distinct tokens that a row holds."""
    found = []
    for block in query_blocks(_asked(queries, query_key, query_text), "q"):
        asked = [list(t) for t in block["t"]]
        words = sorted({w for t in asked for w in t})
        shares = Shares(asked, words, np.ones(len(words)), True)

        def score(batch: pd.DataFrame, words=words, shares=shares):  # noqa: ANN001, ANN202
            row, word = _hits(batch["_t"], pd.Index(words))

            def part(some: slice) -> np.ndarray:
                wanted, share = shares.part(some)
                return np.minimum(_matrix(row, word, len(batch), wanted, len(words)), 1) @ share

            return part

        rows = df.select(key, F.array_distinct(sc.tokens(F.col(text))).alias("_t"))
        found.append(best_in_blocks(rows, key, df.schema[key].dataType.simpleString(), block["q"].tolist(), queries.schema[query_key].dataType.simpleString(), score, k, above=0.0))
    return united(found, df, key, queries, query_key)


def vector_top(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, digits: int = 5) -> DataFrame:
    """Rows (query_id, key, score, rank): exact cosine of every row against every query, in blocks of matrix products."""
    found = []
    for block in query_blocks(queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v IS NOT NULL"), "q"):
        asked = np.array(block["v"].tolist(), float)
        asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)

        def score(batch: pd.DataFrame, asked=asked):  # noqa: ANN001, ANN202
            x = np.array(batch[vector].tolist(), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return lambda some: x @ asked[some].T

        rows = df.select(key, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
        found.append(best_in_blocks(rows, key, df.schema[key].dataType.simpleString(), block["q"].tolist(), queries.schema[query_key].dataType.simpleString(), score, k, digits))
    return united(found, df, key, queries, query_key)


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Rows (query_id, key, rrf): the sum of 1 / (60 + rank) over the lists, rounded to 9 digits."""
    x = lists[0].select("query_id", key, "rank")
    for other in lists[1:]:
        x = x.unionByName(other.select("query_id", key, "rank"))
    return x.groupBy("query_id", key).agg(F.round(F.sum(sc.reciprocal_rank(F.col("rank"))), 9).alias("rrf"))


def ranked(df: DataFrame, by: str, order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    x = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return x if k is None else x.where(F.col(name) <= k)


def content_key(text: Column, key: Column) -> Column:
    """Rows with the same text up to case and white space share it; rows without any text stand alone."""
    own = F.concat(F.lit("id:"), key.cast("string"))
    # The squashed text is computed once, for the test and for the digest.
    return F.coalesce(F.transform(F.array(squash(text)), lambda s: F.when(s != "", F.sha2(s, 256)))[0], own)


def ranking_metrics(results: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """The metrics of ranked results (query_id, item, rank) against gold, rows (query_id, item). See metrics_of_hits."""
    size = gold.groupBy("query_id").agg(F.count_distinct("item").alias("gold"))
    hit = gold.select("query_id", "item").dropDuplicates().withColumn("hit", F.lit(1))
    return metrics_of_hits(results.join(hit, ["query_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0))), size, ks)


def metrics_of_hits(x: DataFrame, size: DataFrame, ks: list[int]) -> DataFrame:
    """Rows (query_id, k, recall, recall_any, recall_all, precision, mrr, ndcg, ndcg_alt) of ranked results.

    x has (query_id, item, rank, hit), size how many items are relevant to each query: (query_id, gold). ndcg discounts by log2(rank + 1) and compares with all relevant results; ndcg_alt does not discount the first
    rank, the i-th by log2(i), and compares with the size of gold.
    """
    x = x.withColumn("relevant", F.sum("hit").over(Window.partitionBy("query_id")))
    x = x.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    gain = lambda at: F.sum(F.col("hit") / at)
    one, alt = F.log2(F.col("rank") + 1), F.when(F.col("rank") == 1, 1.0).otherwise(F.log2(F.greatest("rank", F.lit(2))))
    per = x.groupBy("query_id", "k").agg(
        F.sum("hit").alias("hits"), F.count("*").alias("n"), F.max("relevant").alias("relevant"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), gain(one).alias("dcg"), gain(alt).alias("dcg_alt")
    ).join(size, "query_id")
    ideal = lambda m, f: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i <= m, 1 / f(i)).otherwise(0.0))
    best = ideal(F.least("relevant", "n"), lambda i: F.log2(i + 1))
    best_alt = ideal(F.least("gold", "n"), lambda i: F.when(i == 1, 1.0).otherwise(F.log2(F.greatest(i, F.lit(2)))))
    r = lambda c: F.round(c, 6)
    return per.select(
        "query_id", "k", r(F.col("hits") / F.col("gold")).alias("recall"), F.when(F.col("hits") > 0, 1).otherwise(0).alias("recall_any"), F.when(F.col("hits") == F.col("gold"), 1).otherwise(0).alias("recall_all"),
        r(F.col("hits") / F.col("n")).alias("precision"), r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), r(F.when(F.col("relevant") > 0, F.col("dcg") / best).otherwise(0.0)).alias("ndcg"), r(F.col("dcg_alt") / best_alt).alias("ndcg_alt"),
    )
