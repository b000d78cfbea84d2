"""Problem 7: evaluation passages inside a corpus, found through template windows.

Words are canonicalised: numbers, units and names become typed placeholders. Windows of 13 canonical words (or all words of a shorter
passage) are hashed and hash-joined between corpus and passages; the slots of a joined pair are then compared.

leaked           equal slots. What a word becomes depends on the lower-cased word alone here, so every literal match, in whatever
                 typography, is also a template match: none is lost.
reparameterised  slots that differ, but consistently (each value of the passage always stands for the same other value). Here the text's own
                 shape gives the types, so that values count that no passage has: a number may have a decimal point or comma inside, a
                 unit is the word after a number, a name is a capitalised word that the passages neither write small nor share often.

The passages filter the corpus in the scan by two sets of bits of a fixed size (names and windows; what shares a bit with one of them only
costs work), however many passages there are. Corpus words never leave their task unless their window has such a bit.

Defined results: null passages and passages or texts without words match nothing; items that share a passage all count; repeated
windows, rows and items give one row; texts of any length are used whole; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import WORD, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

SIZE = 13
#: Powers of two: the bits of the set of words, and of the set of windows, that is broadcast (128 kB and 2 MB).
WORD_BITS, WINDOW_BITS = 20, 24
# Units whose exchange does not make another text.
UNITS = frozenset(
    "mm cm m km mg g kg t ml l ms s min h hour hours minute minutes second seconds day days week weeks month months year years "
    "percent euro euros dollar dollars eur usd gbp stunde stunden tag tage woche wochen monat monate monatlich jahr jahre "
    "jour jours semaine semaines mois an ans heure heures día días semana semanas mes meses año años hora horas".split()
)
_BASE = 0x9E3779B97F4A7C15
_SHAPED = r"\p{N}+(?:[.,]\p{N}+)+|" + WORD


def _digest(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * np.uint64(_BASE)) >> np.uint64(64 - bits)


def _bit_set(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The places of all values (strings or 64-bit hashes) as booleans; at most 2 ** bits of them meet on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            hashes = np.fromiter(map(_digest, values.to_pylist()), np.uint64, len(values)) if pa.types.is_string(values.type) else values.to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(hashes, bits)).astype(np.int32))], names=["place"])

    out = np.zeros(1 << bits, bool)
    out[df.select(column).mapInArrow(run, "place int").dropDuplicates().toArrow()["place"].to_numpy()] = True
    return out


def known_words(items: DataFrame, passage: str, share: float = 0.05) -> DataFrame:
    """Rows (word, name) of the lower-cased words of the passages; a name is always capitalised and in at most this share of them."""
    texts = items.where(F.col(passage).isNotNull()).select(F.col(passage).alias("p")).dropDuplicates()
    each = texts.select(F.xxhash64("p").alias("d"), F.explode(F.array_distinct(F.regexp_extract_all("p", F.lit(WORD), F.lit(0)))).alias("w"))
    x = each.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.lower("w")).alias("small"), F.count_distinct("d").alias("n"))
    most = F.greatest(F.lit(2), F.ceil(F.lit(share) * texts.count()))
    return x.select("word", ((F.col("small") == 0) & (F.col("n") <= most)).alias("name"))


def _kind(word: str, listed: np.ndarray, shaped: bool) -> str:
    """The canonical form: a typed placeholder, or the word. listed has the places of names, or (shaped) of words that are none."""
    if any(c.isdigit() for c in word):
        return "\0number"
    low = word.lower()
    if not shaped and low in UNITS:
        return "\0unit"
    known = bool(listed[int(_places(np.array([_digest(low)], np.uint64), WORD_BITS)[0])])
    return "\0name" if (word[0].isupper() and not known if shaped else known) else low


def template_windows(df: DataFrame, key: str, text: str, sizes: list[int], listed: np.ndarray, whole_below: int = 0, wanted: np.ndarray | None = None, shaped: bool = False) -> DataFrame:
    """Rows (key, size, template, words, slots) of the windows of the given sizes; slots are the positions of placeholders.

    With whole_below, a text gives its windows of that size or, if it has fewer words, one window of all of them. With wanted (the bits of
    templates), only windows with one of these bits come out.
    """
    shared = df.sparkSession.sparkContext.broadcast((np.packbits(listed), None if wanted is None else np.packbits(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, want = (None if b is None else np.unpackbits(b).view(bool) for b in shared.value)
        unit = np.uint64(_digest("\0unit"))
        code: dict[str, tuple[int, str]] = {}
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(code) > 1_000_000:
                code = {}
            for w in distinct:
                if w not in code:
                    kind = _kind(w, known, shaped)
                    code[w] = _digest(kind), kind if kind[0] == "\0" else ""
            which = coded.indices.to_numpy(zero_copy_only=False)
            each = lambda f, t: np.fromiter((f(code[w]) for w in distinct), t, len(distinct))[which] if len(distinct) else np.zeros(0, t)
            h, slot = each(lambda c: c[0], np.uint64), each(lambda c: c[1] != "", bool)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(count)
            row = np.repeat(np.arange(len(count)), count)
            if shaped:  # the word after a number is its unit
                number = each(lambda c: c[1] == "\0number", bool)
                after = np.zeros(len(h), bool)
                after[1:] = number[:-1] & ~number[1:] & (row[1:] == row[:-1])
                h, slot = np.where(after, unit, h), slot | after
            todo = sorted({*sizes, *(int(c) for c in np.unique(count) if 0 < c < whole_below)})
            for size in todo:
                last = len(h) - size + 1
                if last <= 0:
                    continue
                rolled = np.zeros(last, np.uint64)
                for j in range(size):
                    rolled += h[j : last + j] * np.uint64(pow(_BASE, j, 1 << 64))
                start = np.arange(last)
                ok = start + size <= ends[row[:last]]
                if whole_below and size < whole_below:
                    ok &= count[row[:last]] == size
                if want is not None:
                    ok &= want[_places(rolled, WINDOW_BITS)]
                hit = start[ok]
                for some in np.array_split(hit, len(hit) // 20_000 + 1):  # bounded batches out
                    put = (some[:, None] + np.arange(size)).ravel()
                    marks = slot[put]
                    offsets = pa.array(np.arange(len(some) + 1) * size, pa.int32())
                    at = pa.array(np.concatenate(([0], np.cumsum(marks.reshape(-1, size).sum(1)))), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row[some])),
                            pa.array(np.full(len(some), size), pa.int32()),
                            pa.array(rolled[some].view(np.int64)),
                            pa.ListArray.from_arrays(offsets, flat.take(pa.array(put))),
                            pa.ListArray.from_arrays(at, pa.array(np.tile(np.arange(size), len(some))[marks], pa.int32())),
                        ],
                        names=[key, "size", "template", "words", "slots"],
                    )

    kind = df.schema[key].dataType.simpleString()
    split = F.regexp_extract_all(F.col(text), F.lit(_SHAPED), F.lit(0)) if shaped else words(F.col(text))
    return df.select(F.col(key), split.alias("_w")).mapInArrow(run, f"`{key}` {kind}, size int, template bigint, words array<string>, slots array<int>")


def matches(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, size: int = SIZE, shaped: bool = False) -> DataFrame:
    """Rows (key, passage_id, words, passage_words, slots, size, template) of all template matches; passage_id is the smallest item with the passage."""
    texts = items.where(F.col(passage).isNotNull()).groupBy(F.col(passage).alias("_p")).agg(F.min(item).alias("passage_id"))
    listed = _bit_set(known_words(items, passage).where(~F.col("name") if shaped else F.col("name")), "word", WORD_BITS)
    theirs = template_windows(texts, "passage_id", "_p", [size], listed, whole_below=size, shaped=shaped)
    theirs = theirs.select("passage_id", "size", "template", F.col("words").alias("passage_words"), "slots").dropDuplicates()
    sizes = sorted(r.size for r in theirs.select("size").dropDuplicates().collect())
    ours = template_windows(corpus, key, text, sizes, listed, wanted=_bit_set(theirs, "template", WINDOW_BITS), shaped=shaped).drop("slots")
    return ours.join(theirs, ["size", "template"])


def leaked(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, size: int = SIZE) -> DataFrame:
    """Rows (key, item): the texts that hold size consecutive words of a passage, or all words of a shorter one."""
    same = matches(corpus, key, text, items, item, passage, size).where("words = passage_words").select(key, "passage_id").dropDuplicates()
    return _by_item(same, items, item, passage).select(key, item).dropDuplicates()


def _by_item(found: DataFrame, items: DataFrame, item: str, passage: str) -> DataFrame:
    """found with a row for each item that has the passage of passage_id."""
    texts = items.where(F.col(passage).isNotNull()).groupBy(F.col(passage).alias("_p")).agg(F.min(item).alias("passage_id"), F.collect_set(item).alias("_items"))
    return found.join(texts.drop("_p"), "passage_id").withColumn(item, F.explode("_items")).drop("_items")


def _reading(words: Column) -> Column:
    """Words without case: that of a name's letters is typography."""
    return F.transform(words, F.lower)


def reparameterised(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, size: int = SIZE, literal: int = 6, least: int = 8) -> DataFrame:
    """Rows (key, item, windows): texts with a passage whose numbers, units or names were exchanged, one for one.

    A window fits if it keeps at least literal words as they are and if its slots map each value of the passage to one value of the text and
    back. A passage counts if half of its windows fit, and no fewer than least unless it has fewer, and some slot differs in one of
    them. Passages that differ only in their names are re-parameterised ones of each other.
    """
    x = matches(corpus, key, text, items, item, passage, size, shaped=True).where(F.size("words") - F.size("slots") >= literal)
    x = x.withColumns({"words": _reading(F.col("words")), "passage_words": _reading(F.col("passage_words"))})
    theirs, ours = F.transform("slots", lambda i: F.get("passage_words", i)), F.transform("slots", lambda i: F.get("words", i))
    pairs = F.array_distinct(F.arrays_zip(theirs.alias("a"), ours.alias("b")))
    one_for_one = (F.size(pairs) == F.size(F.array_distinct(theirs))) & (F.size(pairs) == F.size(F.array_distinct(ours)))
    fit = x.where(one_for_one).groupBy(key, "passage_id", "size", "template").agg(F.bool_or(F.col("words") != F.col("passage_words")).alias("other"))
    found = fit.groupBy(key, "passage_id").agg(F.count("*").alias("windows"), F.bool_or("other").alias("_other")).where("_other")
    long = F.coalesce(F.size(F.regexp_extract_all(F.col(passage), F.lit(_SHAPED), F.lit(0))), F.lit(0)) - size + 1
    needed = items.where(F.col(passage).isNotNull()).groupBy(F.col(passage).alias("_p")).agg(F.min(item).alias("passage_id"), F.min(F.greatest(F.lit(1), F.least(F.lit(least), long), F.ceil(long / 2))).alias("_needed"))
    found = found.join(needed.drop("_p"), "passage_id").where(F.col("windows") >= F.col("_needed"))
    return _by_item(found, items, item, passage).select(key, item, "windows")
