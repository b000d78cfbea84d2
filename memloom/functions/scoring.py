"""Scores of retrieval: keyword coverage, BM25, reciprocal ranks, the weighted final score and its time parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import SPACES

# Words that count as the same in keyword matching.
SYNONYMS = (("father", "dad"), ("mother", "mom"), ("gift", "present"), ("buy", "purchase"), ("job", "work"), ("trip", "travel"))
# Weights of the final score.
WEIGHTS = {
    "keyword": 0.18, "vector": 0.35, "graph": 0.08, "recency": 0.06, "retrieval_weight": 0.015, "user_retrieval_weight": 0.055,
    "source_reliability": 0.05, "feedback": 0.04, "diversity": 0.04, "rrf": 0.08, "conflict": -0.20, "permission_risk": -0.15, "staleness": -0.08,
}
RRF_K = 60


def tokens(text: Column) -> Column:
    """Lower-cased ASCII runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(w: Column) -> Column:
    """A short English stem: ing, ied, sed, ed, ies and s, each with the least length it applies from."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when((n >= 6) & w.endswith("ing"), cut(3))
        .when((n >= 5) & w.endswith("ied"), F.concat(cut(3), F.lit("y")))
        .when((n >= 5) & w.endswith("sed"), cut(1))
        .when((n >= 5) & w.endswith("ed"), cut(2))
        .when((n >= 5) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n >= 4) & w.endswith("s"), cut(1))
        .otherwise(w)
    )


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def reciprocal_rank(rank: Column) -> Column:
    return F.lit(1.0) / (RRF_K + rank)


def recency(age_s: Column) -> Column:
    """1, .8, .6 or .3 within an hour, a day, a week or later; .2 for an unknown age."""
    a = F.abs(age_s)
    return F.when(a.isNull(), 0.2).when(a < 3600, 1.0).when(a < 86400, 0.8).when(a < 604800, 0.6).otherwise(0.3)


def staleness(age_s: Column) -> Column:
    return F.when(age_s.isNull(), 0.2).when(age_s < 7 * 86400, 0.0).when(age_s < 30 * 86400, 0.2).otherwise(0.5)


def final_score(parts: dict[str, Column]) -> Column:
    """The weighted sum of the given parts; a part that is missing counts as 0."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in parts:
            total = total + F.lit(weight) * parts[name]
    return F.round(total, 6)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 if one has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """Tokens a text is likely to need: a quarter of each ASCII word's letters (rounded up), one per CJK character, one per other
    non-ASCII character, and a half for every character that is neither white space, ASCII word nor CJK."""

    def cost(t: Column) -> Column:
        count = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
        ascii_words = F.aggregate(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lit(0.0), lambda s, w: s + F.ceil(F.length(w) / 4))
        cjk = count("[^\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]+")
        other = count("[\\x00-\\x7F\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]+")
        marks = count("[\\sA-Za-z0-9_\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]+")
        return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(ascii_words + cjk + other + marks * 0.5)))

    # White space is put in order once, however often the cost looks at the text.
    return F.transform(F.array(F.trim(F.regexp_replace(text, SPACES, " "))), cost)[0].cast("int")
