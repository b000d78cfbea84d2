import os
import random
import re

import pytest
from pyspark.sql import functions as F

from memloom.llm import contamination as co


TABLES = "/root/testdata/sf0.01"


def words(x):
    return re.findall(r"[^\W_]+", x.lower()) if x else []


def brute(docs, items, size=13):
    out = set()
    for i, p in items:
        w = words(p)
        n = min(size, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, t in docs:
            v = words(t)
            if any(tuple(v[k : k + n]) in wins for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["Anna", "Bob", "the", "keeps", "12", "7", "weeks", "Straße", "ÉCOLE", "x"]
    passages = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 3, 5, 12, 13, 14, 30, 60)]
    items = [*enumerate([*passages, passages[4], None, "", "?!"], 1)]
    docs = [(1, None), (2, ""), (3, "…")]
    for p in passages * 3:
        w = p.split()
        a = r.randrange(max(1, len(w) - 13))
        docs.append((len(docs) + 1, "before — " + ", ".join(w[a : a + r.choice([4, 12, 13, 20])]).upper() + "\n after"))
    docs += docs[3:5]
    corpus = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, size int")
    evals = spark.createDataFrame(items, "item_id bigint, passage string")
    want = brute(docs, items)
    assert {tuple(x) for x in co.leaked(corpus, "doc_id", "text", evals, "item_id", "passage").collect()} == want
    assert co.leaked(corpus.limit(0), "doc_id", "text", evals, "item_id", "passage").count() == 0
    assert co.leaked(corpus, "doc_id", "text", evals.limit(0), "item_id", "passage").count() == 0


def test_bits_that_all_words_and_windows_share(spark, monkeypatch):
    """Full sets of bits filter nothing and lose nothing."""
    p = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    corpus = spark.createDataFrame([(1, "x " + p + " y"), (2, p[:40]), (3, "short passage here")], "doc_id bigint, text string")
    evals = spark.createDataFrame([(1, p), (2, "Short passage")], "item_id bigint, passage string")
    monkeypatch.setattr(co, "WORD_BITS", 1)
    monkeypatch.setattr(co, "WINDOW_BITS", 1)
    assert {tuple(x) for x in co.leaked(corpus, "doc_id", "text", evals, "item_id", "passage").collect()} == {(1, 1), (3, 2)}


PASSAGE = "The tank of Marvin loses 12 litres in 3 hours, and is refilled by 12 pumps of the old mill every 3 days until Anna comes home."
EXCHANGED = {
    "number": PASSAGE.replace("12", "40"),
    "name": PASSAGE.replace("Marvin", "Zorbulon"),
    "unit": PASSAGE.replace("litres", "gallons"),
    "name and number": PASSAGE.replace("Marvin", "Zorbulon").replace("3", "5"),
    "decimal": PASSAGE.replace("12", "4.5"),
}


@pytest.mark.parametrize("case", EXCHANGED)
def test_one_exchange_alone(spark, case):
    corpus = spark.createDataFrame([(1, f"Before. {EXCHANGED[case]} After."), (2, PASSAGE), (3, "Nothing of the old mill.")], "doc_id bigint, text string")
    evals = spark.createDataFrame([(1, PASSAGE), (2, "Quite another text about the mill of Anna.")], "item_id bigint, passage string")
    assert [(r.doc_id, r.item_id) for r in co.reparameterised(corpus, "doc_id", "text", evals, "item_id", "passage").collect()] == [(1, 1)]


def test_inconsistent_exchanges_do_not_count(spark):
    short = "We sell 12 pumps and buy 12 pipes of the old mill for Anna again"
    corpus = spark.createDataFrame([(1, short.replace("12 pumps", "40 pumps")), (2, short.replace("12", "40"))], "doc_id bigint, text string")
    evals = spark.createDataFrame([(1, short)], "item_id bigint, passage string")
    assert [r.doc_id for r in co.reparameterised(corpus, "doc_id", "text", evals, "item_id", "passage").collect()] == [2]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_planted_passages_on_the_tables(spark):
    """Passages whose numbers, or one of whose names, are exchanged for unknown ones, between the texts of the tables."""
    items = spark.read.parquet(f"{TABLES}/eval_items.parquet").select("item_id", "passage")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    r, planted = random.Random(4), []
    for i, p in sorted(map(tuple, items.where("passage IS NOT NULL").collect())):
        names = [w for w in re.findall(r"\w+", p)[1:] if w[0].isupper() and w.lower() not in p and w.isascii()]
        if len(words(p)) >= 25 and names:
            name = r.choice(names)
            planted.append((1_000_000 + i, re.sub(rf"\b{name}\b", "Xu" + "".join(r.choice("bdgklmn") for _ in range(5)), p), i))
    assert len(planted) > 50
    mixed = docs.unionByName(spark.createDataFrame([x[:2] for x in planted], "doc_id bigint, text string"))
    got = {(x.doc_id, x.item_id) for x in co.reparameterised(mixed, "doc_id", "text", items, "item_id", "passage").collect()}
    want = {(d, i) for d, _, i in planted}
    others = {x for x in got if x[0] >= 1_000_000} - want
    windows = {i: {tuple(words(p)[k : k + 13]) for k in range(len(words(p)) - 12)} for i, p in items.where("passage IS NOT NULL").collect()}
    twins = {(d, j) for d, i in want for j in windows if windows[i] & windows[j]}  # passages that share text with the planted one
    print("recall", len(got & want) / len(want), "others of planted", len(others - twins), "rows of the tables", len({x for x in got if x[0] < 1_000_000}))
    assert len(got & want) >= 0.9 * len(want) and len(others - twins) <= 0.1 * len(got)


def test_items_that_share_an_exchanged_passage_all_count(spark):
    p = "The tank of Marvin loses 12 litres in 3 hours and is refilled by 12 pumps every 3 days"
    corpus = spark.createDataFrame([(1, p.replace("12", "40")), (2, p)], "doc_id bigint, text string")
    evals = spark.createDataFrame([(5, p), (7, p), (9, None)], "item_id bigint, passage string")
    got = co.reparameterised(corpus, "doc_id", "text", evals, "item_id", "passage")
    assert got.columns == ["doc_id", "item_id", "windows"] and {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 5), (1, 7)}
