import os
import random

import pytest

from memloom.llm import encoding as en

pytestmark = pytest.mark.skipif(not os.path.exists(en.VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(en.VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_words_against_the_library(reference):
    coder, r = en.PrefixEncoder(open(en.VOCABULARY, "rb").read()), random.Random(5)
    letters = ["a", "b", "th", "ing", "é", "中", "😀", "-", "=", "1"]
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(3000)} | {"a" * n for n in range(1, 200)})
    words = sorted(words, key=str.encode)
    for w, ids in zip(words, coder.encode_sorted([w.encode() for w in words]), strict=True):
        # The library would split some of these first; a word that it keeps whole must agree.
        from tokenizers.pre_tokenizers import ByteLevel

        if len(ByteLevel(add_prefix_space=False).pre_tokenize_str(w)) == 1:
            assert ids == reference(w), w


def test_texts(spark, reference, monkeypatch):
    monkeypatch.setattr(en, "REMEMBERED", 50)
    texts = [None, "", " ", "\n\n  x", "Hello world, it's 3 o'clock.  <|endoftext|> DON'T", "naïve 中文 слово 😀👍🏽 ﻿​ 　 ab", "x" * 20_000, "a b " * 20_000, "\U0001fae8 ࢏ new", "tab\tb\r\nc"] * 2
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in en.encode(df, "doc_id", "text").collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    assert en.encode(df.limit(0), "doc_id", "text").count() == 0
