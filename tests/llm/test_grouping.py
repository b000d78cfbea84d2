from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memloom.llm import grouping as gr


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {(x, root(x)) for x in up}


node = st.one_of(st.none(), st.integers(0, 30).map(lambda i: f"n{i:02}"))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(node, node), max_size=30))
def test_against_union_find(spark, pairs):
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, component int")
    assert {tuple(r) for r in gr.groups(df, "a", "b").collect()} == brute(pairs)


def test_chains_hubs_and_repeats(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    pairs = [*chain, *chain, *[("hub", f"h{i}") for i in range(300)]]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {tuple(r) for r in gr.groups(df, "a", "b").collect()} == brute(pairs)


def test_relations(spark):
    facts = spark.createDataFrame([("F1",), ("f2",), ("f3",), ("f4",), ("f2",), (None,)], "fact_id string")
    rows = [("r1", " Same_Event", [" f1", "F2 ", None, "zz"]), ("r2", "UPDATES", ["f2", "f3", "f3"]), ("r3", "conflicts", ["f3", "f4"]), ("r4", None, ["f3", "f4"]), ("r5", "updates", None), ("r6", "updates", [])]
    relations = spark.createDataFrame(rows, "relation_id string, type string, source_fact_ids array<string>")
    pairs = gr.relation_pairs(relations, facts, ("same_event", "updates"))
    assert {tuple(r) for r in gr.groups(pairs, "a", "b").collect()} == {("F1", "F1"), ("f2", "F1"), ("f3", "F1")}
    assert gr.groups(pairs.limit(0), "a", "b").count() == 0
