"""Every core query with SQL gives the rows of the SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

from memloom.plans import registry

DATA = os.environ.get("MEMLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def sound(df):
    """No row is paired with every other."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return df


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = sound(registry.queries()[name](spark, DATA))
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if DATA == entry.SMALL:
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = sound(registry.queries()[name](spark, DATA))
    assert df.columns and df.count() >= 0


def test_estimated_zones_where_the_zone_is_known(spark):
    from pyspark.sql import functions as F

    from memloom.plans import problems

    times = problems.written_times(spark, DATA)
    known = times.where("status = 'ok' AND how = 'record'").select("record_id", F.col("instant_us").alias("true_us"))
    hide = (F.col("status") == "ok") & (F.col("how") == "record")
    hidden = times.withColumns({"status": F.when(hide, "no_zone").otherwise(F.col("status")), "instant_us": F.when(~hide, F.col("instant_us")), "how": F.when(~hide, F.col("how"))})
    x = problems.estimated(spark, DATA, hidden).where("how = 'estimated'").join(known, "record_id").select((F.col("instant_us") == F.col("true_us")).cast("int").alias("right"))
    r = x.agg(F.count("*").alias("n"), F.avg("right").alias("share")).first()
    print("estimated", r.n, "of", known.count(), "right", r.share)
    assert r.n > 0.8 * known.count() and r.share > 0.97
