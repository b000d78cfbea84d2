from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions import temporal as tm
from memloom.operators import chunks as ch
from memloom.operators import components as cp
from memloom.operators import packing as pk
from memloom.operators import retrieval as r
from memloom.operators.overlap import overlap_join
from memloom.operators.slices import lead_across, running_sum

t = datetime


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'timestamp' if v is None or isinstance(v, datetime) else 'string'}" for k, v in values.items()))


@pytest.mark.parametrize(
    "start, end, hit, envelope",
    [
        (t(2024, 1, 1), None, True, True), (t(2024, 2, 1), None, False, False), (t(2024, 2, 1), t(2024, 2, 1), False, False), (t(2023, 12, 1), t(2024, 1, 1), False, True),
        (t(2023, 12, 1), t(2024, 1, 2), True, True), (t(2024, 1, 31), t(2025, 1, 1), True, True), (None, t(2024, 1, 5), False, True), (None, None, False, False),
    ],
)
def test_interval_predicates_at_their_edges(spark, start, end, hit, envelope):
    from_, to = F.lit(t(2024, 1, 1)), F.lit(t(2024, 2, 1))
    x = one(spark, s=start, e=end).select(tm.intersects(F.col("s"), F.col("e"), from_, to).alias("h"), tm.envelope_intersects(F.col("s"), F.col("e"), from_, to).alias("v")).first()
    assert (x.h, x.v) == (hit, envelope)


def test_local_days_and_cutoffs(spark):
    x = one(spark, at=t(2025, 3, 30, 12)).select(tm.local_day_start(F.col("at"), "Europe/Berlin").alias("d"), tm.last_cutoff(F.col("at"), "Europe/Berlin").alias("c")).first()
    assert x.d == t(2025, 3, 29, 23) and x.c == t(2025, 3, 29, 22)  # the day clocks went forward


@pytest.mark.parametrize("word, stem", [("running", "runn"), ("sing", "sing"), ("tried", "try"), ("based", "base"), ("used", "used"), ("jumped", "jump"), ("cities", "city"), ("cats", "cat"), ("gas", "gas"), ("red", "red")])
def test_stems(spark, word, stem):
    assert one(spark, w=word).select(sc.stem(F.col("w"))).first()[0] == stem


@pytest.mark.parametrize("text, n", [("", 0), ("  ", 0), ("hello", 2), ("a b", 2), ("中文", 2), ("é", 2), ("a,b", 3)])
def test_token_estimates(spark, text, n):
    assert one(spark, x=text).select(sc.token_estimate(F.col("x"))).first()[0] == n


def test_cosine_of_uneven_and_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 9.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [x[0] for x in df.select(sc.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_keyword_search_with_ties_nulls_and_no_words(spark):
    docs = spark.createDataFrame([(1, "the dogs bark"), (2, "the dog barks"), (3, None), (4, ""), (5, "my dad"), (6, "the dogs bark")], "id bigint, text string")
    asked = spark.createDataFrame([("a", "dogs bark"), ("b", "father"), ("c", "..."), ("d", None)], "q string, query string")
    got = {(x.query_id, x.id): (x["rank"], x.score) for x in r.keyword_top(docs, "id", "text", asked, "q", "query", 3).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 6), ("b", 5)}
    assert got[("a", 1)] == (1, 0.7) and got[("a", 6)][0] == 2 and got[("a", 2)] == (3, 0.3) and got[("b", 5)] == (1, 0.3)
    assert r.bm25_top(docs.limit(0), "id", "text", asked, "q", "query", 3).count() == 0


def test_metrics_with_hits_beyond_and_without_gold(spark):
    results = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 1)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("a", "y"), ("a", "w"), ("b", "q")], "query_id string, item string")
    got = {(x.query_id, x.k): x for x in r.ranking_metrics(results, gold, [1, 2]).collect()}
    a = got[("a", 2)]
    assert (a.recall, a.precision, a.mrr, a.recall_any, a.recall_all) == (0.5, 0.5, 0.5, 1, 0)
    assert a.ndcg == pytest.approx(0.63093, abs=1e-5) and a.ndcg_alt == 0.5
    assert (got[("a", 1)].mrr, got[("b", 1)].ndcg) == (0.0, 0.0)


def test_content_keys(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a B "), (3, None), (4, " "), (5, None)], "id bigint, text string")
    keys = {x.id: x.k for x in df.select("id", r.content_key(F.col("text"), F.col("id")).alias("k")).collect()}
    assert keys[1] == keys[2] and len({keys[3], keys[4], keys[5]}) == 3


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50), st.integers(0, 50)), max_size=25), st.integers(1, 20))
def test_overlap_join_against_all_pairs(spark, rows, width):
    rows = [(i, *x) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, k string, start_us bigint, end_us bigint")
    got = sorted((x.id, x.r_id) for x in overlap_join(df, df, ["k"], width).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9)), max_size=30))
def test_order_across_slices(spark, rows):
    rows = [(k, i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("slice", F.floor(F.col("i") / 4))
    for name, x in (("lead", lead_across(df, ["k"], F.col("v"), "i", "out")), ("sum", running_sum(df, ["k"], F.col("v"), "i", "out"))):
        got = {(y.k, y.i): y.out for y in x.collect()}
        for k, i, _ in rows:
            own = [z for z in rows if z[0] == k]
            want = next((z[2] for z in own if z[1] > i), None) if name == "lead" else sum(z[2] for z in own if z[1] < i)
            assert got[(k, i)] == want


def test_components_by_keys(spark):
    rows = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("d", None), (None, "1"), *[(f"x{i:02}", f"k{i}") for i in range(30)], *[(f"x{i:02}", f"k{i + 1}") for i in range(30)]]
    df = spark.createDataFrame(rows, "i string, k string")
    got = {x["item"]: x.component for x in cp.components_by_keys(df, "i", "k").collect()}
    assert got["c"] == "a" and got["d"] == "d" and {got[f"x{i:02}"] for i in range(30)} == {"x00"}
    assert cp.components_by_keys(df.limit(0), "i", "k").count() == 0


def test_items_that_do_not_fit_use_nothing(spark):
    rows = [("g", 1, "a", 6), ("g", 2, "b", 5), ("g", 3, "c", 4), ("g", 4, "d", None), ("h", 1, "e", 11)]
    df = spark.createDataFrame(rows, "g string, r int, item string, cost int")
    assert sorted(map(tuple, pk.select_within_budget(df, "g", "r", "item", "cost", 10).collect())) == [("g", "a", 6), ("g", "c", 10), ("g", "d", 10)]


@settings(max_examples=100, deadline=None)
@given(st.text("ab .。\n!", max_size=200), st.integers(1, 40))
def test_chunks_put_together_are_the_text(text, most):
    parts = list(ch.pieces(text, most))
    assert "".join(p for _, p in parts) == text and all(0 < len(p) <= most for _, p in parts)


def test_query_sets_of_many_blocks_and_matrices_of_few_cells(spark, monkeypatch):
    """The same results whatever the sizes of blocks and matrices; ties go by key."""
    from memloom.operators import blocks
    from memloom.operators import retrieval as r

    docs = spark.createDataFrame([(i, f"father buys {'red' if i % 3 else 'blue'} car{i % 5} and car{i % 7}") for i in range(60)] + [(60, None), (61, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, f"dad bought car{i % 6} red{'s' if i % 2 else ''}") for i in range(25)] + [(25, None), (26, "?!")], "item bigint, query string")
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(80)], "v bigint, e array<float>")
    runs = []
    for limit, cells in ((20_000, 4_000_000), (6, 20)):
        monkeypatch.setattr(blocks, "LIMIT", limit)
        monkeypatch.setattr(blocks, "CELLS", cells)
        found = [f(docs, "doc_id", "text", asked, "item", "query", 3) for f in (r.keyword_top, r.bm25_top, r.coverage_top)] + [r.vector_top(vectors, "v", "e", vectors.where("v % 3 = 0"), "v", "e", 4)]
        runs.append([sorted(map(tuple, x.collect())) for x in found])
    assert runs[0] == runs[1] and all(runs[0]) and len({x[0] for x in runs[0][0]}) == 25
    assert r.keyword_top(docs, "doc_id", "text", asked.limit(0), "item", "query", 3).count() == 0


def test_page_cursors_go_round_and_scope_is_optional(spark):
    from memloom.plans import records as rec

    df = spark.createDataFrame([("a", 3, "t", "active"), ("ü|", None, "t", "rejected"), (None, 1, "u", None)], "id string, n int, tenant_id string, status string")
    x = df.withColumn("c", rec.encode_cursor(id=F.col("id"), n=F.col("n"))).withColumn("p", rec.decode_cursor(F.col("c"), "id string, n int"))
    assert all((r.p.id, r.p.n) == (r.id, r.n) for r in x.collect())
    assert df.select(rec.decode_cursor(F.lit("no cursor!"), "id string").alias("p")).first().p is None
    assert [rec.owner_scope(df, *a, inactive=b).count() for a, b in (((), False), ((), True), (("t",), True), (("t",), False))] == [1, 3, 2, 1]
