from datetime import datetime, timedelta, timezone

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memloom.operators import intervals as iv

ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def brute(rows):
    out, gaps = [], []
    for k in sorted({r[0] for r in rows}):
        cur = None
        for s, e in sorted((s, e) for q, s, e in rows if q == k and s is not None and e is not None and e > s):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                continue
            if cur:
                out.append((k, *cur))
                gaps.append((k, cur[1], s))
            cur = [s, e]
        if cur:
            out.append((k, *cur))
    return sorted(out), sorted(gaps)


bound = st.one_of(st.none(), st.integers(0, 60))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), bound, bound), max_size=40))
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, start_us bigint, end_us bigint")
    periods, gaps = brute(rows)
    for most in (2, 1_000_000):  # few rows a slice: most intervals cross several
        assert sorted(map(tuple, iv.gaps(df, ["k"], most).collect())) == gaps
        assert sorted(map(tuple, iv.periods(df, ["k"], most).collect())) == periods


def test_axes_nulls_and_touching(spark):
    t = lambda x: None if x is None else ZERO + timedelta(microseconds=x)
    rows = [("e", t(0), t(10), t(5), t(5)), ("e", t(10), t(20), None, t(9)), ("e", t(21), t(22), t(9), t(3)), ("e", t(21), t(22), t(1), t(2))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "entity string, s timestamp, e timestamp, es timestamp, ee timestamp, axis string, slice int")
    x = iv.axis_intervals(df, "entity", {"valid": ("s", "e"), "evidence": ("es", "ee")})
    assert [tuple(r) for r in iv.gaps(x, ["entity_id", "axis"]).collect()] == [("e", "valid", 20, 21)]
    assert {tuple(r) for r in iv.periods(x, ["entity_id", "axis"]).collect()} == {("e", "valid", 0, 20), ("e", "valid", 21, 22), ("e", "evidence", 1, 2)}
    assert iv.gaps(x.limit(0), ["entity_id", "axis"]).count() == 0


def test_session_windows_and_lead_decide(spark, monkeypatch):
    """Without the merge of session_window the same steps find gaps inside a period."""
    df = spark.createDataFrame([("a", 0, 50), ("a", 10, 12), ("a", 20, 60), ("a", 70, 80), (None, 1, 2), (None, 5, 6)], "k string, start_us bigint, end_us bigint")
    assert [tuple(r) for r in iv.gaps(df, ["k"]).collect()] == [("a", 60, 70)]
    plan = iv.gaps(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "lead(" in plan and "session_window" in plan
    monkeypatch.setattr(iv, "merge_in_slices", lambda x, keys, rows: iv._sliced(x, keys, rows))
    assert [tuple(r) for r in iv.gaps(df, ["k"]).collect()] != [("a", 60, 70)]
