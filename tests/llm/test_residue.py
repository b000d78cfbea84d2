import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import residue as rs

LARGER = os.environ.get("MEMLOOM_LARGER_DATA", "/root/testdata/sf0.1")
NAMES = ["Anna", "Bob", "Cora", "Dana", "Emil", "Faro", "Gina", "Hugo"]
PLAIN = [
    "{a} moved the meeting to the garden because {b} was late.", "Nobody in the office of {a} reads the report about {b}.", "The invoice for week {n} was paid by {a} and {b}.",
    "{a} asked why the crawler stored \"please enable JavaScript\" notices in the draft.", "An internal server error delayed the work of {a} by {n} minutes.", "{a} likes the library and the old bicycle of {b}.",
]
BAD = ["Lorem ipsum dolor sit amet, consectetur {a} elit.", "404 Not Found\n\nThe page {a} could not be located on this server.", "Please enable JavaScript to view {a}.", "Text goes here. More {a} text goes here.", "Internal Server Error. Reference id {n}-{a}."]


def fill(t, i):
    return t.format(a=NAMES[i % 8], b=NAMES[(i * 3 + 1) % 8], n=i % 50)


def corpus():
    good = [" ".join(fill(PLAIN[(i + k) % 6], i + k) for k in range(4)) for i in range(240)]
    bad = [fill(BAD[i % 5], i) for i in range(30)] + [f"# {NAMES[i % 8]}\n\n{good[i]}\n\n## Part\n\n{fill(BAD[i % 5], i)}" for i in range(20)]
    slots = ["Dear {{user_name}}, thank you.", "Hello {{ user_name }}, the plan of {{owner}} holds.", "Owner: [owner]\nScope: %user_name%", "Summary of {{owner}}: done.", good[0] + " Hello <YOUR_owner>!"]
    fine = [
        good[3] + "\n```\ngreeting = \"Hi ${user_name}\"\n```\n", good[4] + " The engine writes `{{user_name}}` there.", good[5] + " He [laughs] (see [2]) at 30% off; items[4] {\"limit\": 3} [x](http://a).",
        None, "", " \n", "???", good[6] * 300, good[7] + "\n\n" + fill(PLAIN[3], 3),
    ]
    return good, bad, slots, fine


def test_sections_slots_and_mentions(spark):
    good, bad, slots, fine = corpus()
    texts = good + bad + slots + fine
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, h int")
    got = {r.doc_id for r in rs.residue(df, "doc_id", "text").collect()}
    want = set(range(len(good), len(good) + len(bad) + len(slots)))
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rs.residue(df, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert rs.residue(df, "doc_id", "text").count() == 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [texts[r.doc_id] for r in rs.residue(df, "doc_id", "text").orderBy("doc_id").collect()]


def test_hashes_pipes_tildes_and_blank_runs(spark):
    clear = ["Dear {{user_name}}, thanks.", "Hello {{user_name}} and {{owner}}.", "Ask {{owner}}.", "To {{COMPANY}}.", "By {{COMPANY}}."]
    slots = ["Dear #user_name#, thanks.", "Owner: ______", "Owner ____ signs.", "Sold to |COMPANY|, Berlin", "Ask ~owner~ again.", "Dear *|COMPANY|*,"]
    fine = ["# owner\\n\\nWell.", "|owner|company|\\n|---|---|\\n|Anna|x|", "~~owner~~ Anna", "The owner _ or __ or `Owner: ____`.", "Sum: ______", "Tag #owner is set."]
    assert found(spark, clear + slots + fine) == clear + slots


def test_a_rare_family_of_a_large_corpus_counts_whole(spark):
    """What ties zonk to trusted words are some 15 of 60,000 texts, none of which a sample by the hash of the key holds."""
    kind = "CASE WHEN id % 300 = 0 THEN 1 WHEN id % 2500 = 1 AND pmod(xxhash64(id), 1000000) > 400000 THEN 2 WHEN id % 5000 = 2 THEN 3 ELSE 0 END AS kind"
    text = """CASE kind WHEN 1 THEN 'Lorem ipsum dolor sit amet.' WHEN 2 THEN 'zonk dolor sit amet.' WHEN 3 THEN 'zonk.'
              ELSE concat('the old garden of Anna keeps ', char(97 + id % 26), char(97 + id % 23), 'x.') END AS text"""
    df = spark.range(60_000).selectExpr("id", kind).selectExpr("id AS doc_id", "kind", text)
    assert {r.doc_id for r in rs.residue(df, "doc_id", "text").collect()} == {r.doc_id for r in df.where("kind > 0").collect()}


def test_the_weights_decide(spark):
    _, bad, slots, _ = corpus()
    df = spark.createDataFrame(list(enumerate(bad + slots)), "doc_id bigint, text string")
    assert rs.decide(rs.evidence(df, "doc_id", "text"), "doc_id", np.zeros(rs.SIZE)).count() == 0


def test_weights_do_not_depend_on_the_size_of_the_corpus():
    counts, yes = np.zeros(rs.SIZE), np.zeros(rs.SIZE)
    counts[:3], yes[:3] = (20, 500, 9), (20, 4, 0)
    small, large = rs.weigh(counts, yes, 6_000, 25), rs.weigh(counts * 1e12, yes * 1e12, 6_000e12, 25e12)
    assert small[0] > 5 and small[1] > 0.5 > small[2] and np.allclose(small, large)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables here")
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_whose_phrases_are_withheld(spark, monkeypatch, seed):
    """Half of the phrases teach the classifier those of the other half."""
    df = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    half = random.Random(seed).sample(rs.TRUSTED, len(rs.TRUSTED) // 2)
    begins = lambda phrases: r"(?iU)^\s*(?:" + "|".join(phrases) + ")"
    trusted = df.where("text IS NOT NULL").select("doc_id", F.explode(rs.bodies_of(F.col("text"))).alias("b")).where(F.length("b") <= rs.TRUSTED_LENGTH)
    monkeypatch.setattr(rs, "_BEGINS", begins(half))
    got = {r.doc_id for r in rs.residue(df, "doc_id", "text").collect()}
    kept = {r.doc_id for r in trusted.where(F.col("b").rlike(begins(half))).collect()}
    held = {r.doc_id for r in trusted.where(F.col("b").rlike(begins(rs.TRUSTED))).collect()} - kept
    assert len(held) > 20 and len(got & held) >= 0.9 * len(held)


def test_many_names_and_names_of_any_script(spark):
    many = [f"Dear {{{{{a}{i}x}}}}, hello." for i in range(1_100) for a in ("name", "name")]
    clear = ["Liebe {{first-name}}!", "An {{first-name}}.", "你好，{{姓名}}。", "致 {{姓名}}：", "Only {{größe}} once."]
    slots = ["Dear [name7x], hi.", "Dear %name1099x%, hi.", "By <name500x>.", "Für [first-name] da.", "【请填写姓名】", "[请填写姓名]", "姓名：____", "{姓名:先生}", "[see %name9x% now]", "__name8x__", "To &LT;NAME3X&GT;."]
    fine = ["See [größe] there.", "A [name] of {name7xyz}.", "【姓】", "first-nameless ____"]
    assert sorted(set(found(spark, many + clear + slots + fine))) == sorted({*many, *clear, *slots})


def test_passages_and_words_are_those_of_plain_patterns(spark, monkeypatch):
    """The faster patterns give the features of the plain ones."""
    texts = ["a.\n\nb! c", "今天。\n明天！后天?  x.y", "wait...  what?! 12 ½ ²x ⅷ", "…\r\n. ", "größe 姓名ab,々〆〇 ⺀⻳ かなカナ 한글", "é́x_y a1b2 ：１２", "a.。b？c! d.\x0b\x85e", "𠀀𠀁𠀂 ǆ ㍿㊀", "。。a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t"))
    fast = [r.f for r in df.select(rs.features_of(F.col("t")).alias("f")).collect()]
    monkeypatch.setattr(rs, "_PASSAGE", r"(?<=[.!?])\s+|[\r\n]+|(?<=[。！？])")
    monkeypatch.setattr(rs, "_TOKEN", r"[\p{L}&&[^\p{IsHan}]]+|\p{IsHan}{1,2}|\p{N}+")
    assert fast == [r.f for r in df.select(rs.features_of(F.col("t")).alias("f")).collect()]
    assert [len(f) for f in fast[:2]] == [3, 4]


def test_ascii_passages_and_words_are_those_of_the_general_patterns(spark, monkeypatch):
    every = "".join(map(chr, range(128)))
    texts = [every, " ".join(every), "1".join(every), "a".join(every), "a. b!  c?d.e\r\n\r\nF 12b3..", "x.\x0b\x1cy", "ascii here. größe there! 12 and 今天。ok. last", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast = [r.f for r in df.select(rs.features_of(F.col("t")).alias("f")).collect()]
    monkeypatch.setattr(rs, "_ASCII_PASSAGE", rs._PASSAGE)
    monkeypatch.setattr(rs, "_ASCII_TOKEN", rs._TOKEN)
    assert fast == [r.f for r in df.select(rs.features_of(F.col("t")).alias("f")).collect()]
    assert len(fast[4]) == 4 and fast[7] == []
