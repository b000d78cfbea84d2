import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memloom.llm import near_duplicates as nd


def brute(rows, threshold):
    out = set()
    for field in (1, 2):
        sets = [(r[0], frozenset(re.findall(r"[^\W_]+", (r[field] or "").lower()))) for r in rows]
        out |= {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and x and y and len(x & y) / len(x | y) >= threshold}
    return out


text = st.one_of(st.none(), st.lists(st.sampled_from("a b c d e f g h i j k l".split()), max_size=9).map(" ".join))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([f"f{i}" for i in range(25)]), text, text), max_size=30), st.sampled_from([0.3, 0.5, 0.75, 0.8]))
def test_against_all_pairs(spark, rows, threshold):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, t string, c string, cls string")
    got = {tuple(r) for r in nd.similar_records(df, "id", ["t", "c"], threshold).collect()}
    assert got == brute(rows, threshold)


@pytest.mark.parametrize("group,rare,long", [(3, 0, 64), (3, 1000, 64), (32, 2, 6), (1, 0, 2)])
def test_groups_and_keys_of_all_kinds(spark, monkeypatch, group, rare, long):
    monkeypatch.setattr(nd, "GROUP", group)
    monkeypatch.setattr(nd, "RARE", rare)
    monkeypatch.setattr(nd, "LONG", long)
    rows = [(f"f{i:03}", " ".join(["rare", "pair", *[f"w{(i // 2 + j) % 40}" for j in range(8)]]), " ".join(f"v{j}" for j in range(i % 11))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, t string, c string")
    assert {tuple(r) for r in nd.similar_records(df, "id", ["t", "c"], 0.75).collect()} == brute(rows, 0.75)


def test_groups_hold_neighbours_and_the_union_prunes(spark):
    """Texts of one pattern share its words and some rare names with many others, but few share enough."""
    r = random.Random(6)
    name = lambda: f"n{r.randrange(900)}"
    rows = [(f"f{i:03}", f"{name()} moved the {name()} rollout from {name()} to {name()} after {name()} saw {name()} near {name()}", None) for i in range(600)]
    rows += [(f"g{i:03}", rows[i][1] + " again", None) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, t string, c string")
    kept = nd.classes(df, "id", ["t", "c"])
    sets = nd.cut(nd.matrix(kept.select("cls", "tokens").dropDuplicates(["cls"]), nd._counts(kept)))
    assert sets.groupBy("grp").count().agg({"count": "max"}).first()[0] <= nd.GROUP and sets.select("grp").distinct().count() < 80
    tried = nd.tried_groups(sets, 0.75)
    assert nd.qualifying_groups(tried, sets, 0.75).count() < 0.5 * tried.count()


def test_links_without_pairs(spark):
    rows = [(f"c{i:02}", "one two three four", None) for i in range(12)] + [("d", "one two three four five", None), ("e", "other words", "x y"), ("f", None, "x y")]
    df = spark.createDataFrame(rows, "id string, t string, c string")
    edges, links = nd.linked_records(df, "id", ["t", "c"], 0.75)
    want = {}
    for p in brute(rows, 0.75):
        for x in p:
            want[x] = want.get(x, 0) + 1
    assert {r.record: r.links for r in links.collect()} == want
    assert edges.count() == 11 + 1 + 1  # a star, its tie to d, and e - f


def test_long_texts_copies_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [("a", long, None), ("a", long, None), ("b", long + " more", ""), ("c", "   ", "!!!")]
    df = spark.createDataFrame(rows, "id string, t string, c string")
    assert [tuple(r) for r in nd.similar_records(df, "id", ["t", "c"], 0.75).collect()] == [("a", "b")]
    assert nd.similar_records(df.limit(0), "id", ["t", "c"], 0.75).count() == 0


def test_no_table_of_classes_or_records_is_broadcast(spark):
    """Their files can be far smaller than what they take in the driver's memory."""
    rows = [(f"c{i:02}", "one two three four", None) for i in range(12)] + [("d", "one two three four five", None), ("e", "other words", "x y"), ("f", None, "x y")]
    df = spark.createDataFrame(rows, "id string, t string, c string")
    kept = nd.classes(df, "id", ["t", "c"])
    sets = nd.cut(nd.matrix(kept.select("cls", "tokens").dropDuplicates(["cls"]), nd._counts(kept)))
    for x in (nd.similar_classes(sets, 0.75), nd.similar_records(df, "id", ["t", "c"], 0.75), *nd.linked_records(df, "id", ["t", "c"], 0.75)):
        x.collect()
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
