"""The llm queries give the rows of their SQL, or of brute force, on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from memloom.llm import contamination, encoding, near_duplicates, registry, residue
from memloom.llm.queries import FIELDS, SIMILAR
from tests.llm.test_contamination import brute as passages
from tests.llm.test_grouping import brute as united
from tests.llm.test_near_duplicates import brute as similar
from tests.test_queries import DATA, duck, plain, pytestmark, sound  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):  # noqa: F811
    df = sound(registry.queries()[name](spark, DATA))
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in rel.fetchall())


def query(spark, name):
    return sound(registry.queries()[name](spark, DATA))


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(*columns).collect()]


def test_near_duplicates_against_all_pairs(spark):
    pairs = similar(rows(spark, "fact_items", "fact_id", *FIELDS), SIMILAR)
    assert pairs and {tuple(r) for r in query(spark, "p2_found").collect()} == pairs
    groups = {(r.fact_id, r.group_id) for r in query(spark, "p2_groups").collect()}
    assert groups == united(pairs)


def test_ids_against_the_library(spark):
    if not os.path.exists(encoding.VOCABULARY):
        pytest.skip("no vocabulary files here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.VOCABULARY)
    t.encode_special_tokens = True
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in rows(spark, "documents", "doc_id", "text")}
    assert {r.doc_id: r.ids for r in query(spark, "p6_ids").collect()} == want


def test_leaks_against_brute_force(spark):
    docs, items = rows(spark, "documents", "doc_id", "text"), rows(spark, "eval_items", "item_id", "passage")
    leaks = {tuple(r) for r in query(spark, "p7_found").collect()}
    assert leaks == passages(docs, items)
    known, texts = dict(items), dict(docs)
    words = lambda x: set(re.findall(r"[^\W_]+", x.lower()))
    for r in query(spark, "p7_reparameterised").collect():  # re-parameterised texts keep half of a passage's words
        assert r.windows > 0 and 2 * len(words(known[r.item_id]) & words(texts[r.doc_id])) >= len(words(known[r.item_id])) - 13


def test_unmistakable_slots_are_residue(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    bare = residue.without_code(F.lower(F.col("text")))
    clear = {r.doc_id for r in docs.where(bare.rlike(f"(?i){residue._CLEAR}")).collect()}
    got = {r.doc_id for r in query(spark, "p8_found").collect()}
    assert clear <= got <= {r.doc_id for r in docs.where(F.trim("text") != "").collect()}


def test_every_query_is_tested():
    assert set(registry.queries()) == set(registry.oracle_sql()) | {"p2_found", "p2_groups", "p6_ids", "p7_found", "p7_reparameterised", "p8_found"}
    assert contamination.SIZE == 13 and near_duplicates.GROUP <= 64
