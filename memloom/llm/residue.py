"""Problem 8: filler, error pages, script notices and unfilled templates, found by positive-unlabelled naive Bayes.

evidence  One scan of the corpus. A text without its code is split into the bodies of its sections and these into passages; a passage is the
          set of its words. Whatever stands in the shape of a slot is a passage too, once for each name that it can be read with.
learn     Bodies that begin with one of a few well-known phrases (TRUSTED) and slots of an unmistakable shape ({{x}}, <%= x %>, @@x@@, ...)
          are the trusted records; everything else is unlabelled. Expectation-maximization over all of it refines which unlabelled ones are
          residue, with the trusted ones fixed, and gives each word and each name its weight.
residue   Every passage is scored. A body is residue if it has a residue passage and no ordinary one, a slot if its score says so, and a text
          if one of its bodies or slots is. Trust decides nothing here: without weights nothing is found. Mentions of such phrases lose
          against the ordinary words around them.

The phrases need not be complete: families of residue that share bodies or words with trusted ones get their weights from these.

Defined results: null, empty and blank texts are no cases; a text without any word is none either; repeated texts are judged alike; texts
are used whole; code (fenced, inline, indented) does not count; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import cut, forget

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

#: Buckets of words, and those of the names of slots that follow them.
BUCKETS, NAMES = 1 << 21, 1 << 18
#: The bucket that says that a slot has an unmistakable shape; no name has it.
UNMISTAKABLE = BUCKETS + NAMES
SIZE = UNMISTAKABLE + 1
#: Least score of the residue passage that a body must have, and of all its passages.
SURE, ORDINARY = 4.0, -2.0
#: How far below ORDINARY a passage still leaves its body as likely residue as not, in expectation-maximization.
SLACK = 2.0
#: Least score of a slot: about two unmistakable slots with its name, whatever the number of others.
SLOT = 0.4
#: Share of the passages, of residue and of the rest, that every word is taken to have besides its own: rare words weigh little.
RATE = 0.0007
#: Longest body that a phrase at its beginning makes a trusted one; longer ones are unlabelled and scored like all others.
TRUSTED_LENGTH = 600
#: Beliefs below this count as none.
FAINT = 1e-4
CLIP = 6.0
ROUNDS = 7

# How some well-known filler, error messages and script notices begin, in lower case.
TRUSTED = (
    r"lorem ipsum", r"text goes here", r"placeholder", r"coming soon", r"todo: write", r"hier steht später", r"platzhalter", r"contenu à venir", r"texto de (relleno|ejemplo)",
    r"próximamente", r"此处填写", r"敬请期待",
    r"(error )?404 not found", r"http [45]\d\d\b", r"<html><head><title>\d+ error", r"we couldn't find", r"traceback \(most recent", r"50\d (bad gateway|internal server error|service unavailable)", r"internal server error", r"page not found", r"access denied", r"seite nicht gefunden",
    r"erreur \d+", r"página no encontrada", r"页面不存在",
    r"(please )?enable javascript", r"javascript is (disabled|required)", r"bitte aktivieren sie javascript", r"veuillez activer javascript", r"active javascript", r"请启用 ?javascript",
)
_BEGINS = r"(?iU)^\s*(?:" + "|".join(TRUSTED) + ")"
_HEADING = r"(?m)^(?:#{1,6}[ \t]+.*|==+[ \t]*\S.*|<[hH][1-6]>[^<\r\n]*(?:</[hH][1-6]>)?[ \t]*)$"
# Begins with one class of characters, which most fail at once. The marks that it takes off a passage belong to no word; passages without words are dropped.
_PASSAGE = r"[.!?\r\n。！？](?:(?<=[\r\n。！？])|\s+)"
# Words without Han, pairs of Han, numbers. No Han character comes before 2E80; the script of a character is dear to look up, so plain letters are tried first.
_TOKEN = r"[a-z[\p{L}&&[\x{0}-\x{2E7F}[^\p{IsHan}]]]]+|[\x{2E80}-\x{10FFFF}&&\p{IsHan}]{1,2}|\p{N}+"
# The same for texts of ASCII characters alone, whose classes are looked up in one table.
_ASCII_PASSAGE, _ASCII_TOKEN = r"[.!?\r\n](?:(?<=[\r\n])|\s+)", r"[a-zA-Z]+|[0-9]+"
_CODE = r"(?ms)```(?!context-session).*?(?:```|\z)|^~~~.*?(?:^~~~|\z)|`[^`\n]+`|^(?: {4}|\t)[^\n]*$"
_NAME = r"\p{L}[\p{L}\p{M}\p{N}_.-]{0,80}"
_CLEAR = (
    rf"\{{\{{\s*({_NAME})\s*(?:\|[^{{}}\n]{{0,40}})?\}}\}}|@@({_NAME}?)@@|<%=?\s*({_NAME})\s*%>|\[(?:INSERT|insert)\s+({_NAME})\s+(?:HERE|here)\]"
    rf"|\[TODO:\s*({_NAME})\]|<YOUR_({_NAME})>|\$\{{({_NAME})\}}|\{{!({_NAME})!\}}"
)
_OPENER = r"[\[{<%@$«【&_\\(]|[#|~][\w\p{L}]"
_FILLER = r"[^\[\]{}<>«»【】\n]{0,24}"
# All other shapes; the last one holds those that hold no others. Between # | ~ also *|name|*, but neither cells of tables nor ~~struck out~~.
_SHAPES = (
    rf"\[+(?:[A-Z:]{{3,12}}\s+|请?填写)?{_NAME}(?:\s{_FILLER})?\]+(?!\()", rf"\{{[{{!%#]?\s*{_NAME}\s*[:|]?[^{{}}\n]{{0,24}}\}}", rf"<{{1,2}}{_NAME}(?:\s{_FILLER})?>", rf"&lt;{_NAME}(?:\s{_FILLER})?&gt;",
    r"【[^【】\n]+】", rf"__{_NAME}__",
    rf"«\s*{_NAME}\s*»|\$+{_NAME}(?=\$)|%{_NAME}(?=%)|%\({_NAME}\)|@{{1,2}}{_NAME}(?=@)|\({_NAME}[:：]?\s*_{{3,}}\)"
    rf"|#{_NAME}(?=#)|(?<![\w|])\|{_NAME}(?=\|(?![\w|]))|(?<![\w~])~{_NAME}(?=~(?![\w~]))",
)
_BLANK = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_.-]){_NAME}?[:：]?\s*_{{4,}}"


def bodies_of(text: Column) -> Column:
    """The bodies of the sections of a text: what lies between headings; the whole text if it has none."""
    return F.split(text, _HEADING)


def trusted_body(body: Column) -> Column:
    return (F.length(body) <= TRUSTED_LENGTH) & body.rlike(_BEGINS)


def _bucket(token: Column) -> Column:
    return F.xxhash64(token).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")  # BUCKETS is a power of 2


def _name_bucket(name: Column) -> Column:
    return (F.pmod(F.xxhash64(name), F.lit(NAMES)) + BUCKETS).cast("int")


def features_of(body: Column) -> Column:
    """Of each passage of a body in lower case the buckets of its distinct words and of the word it begins with: Han text by pairs of characters, numbers by their length."""
    ascii_ = lambda x: F.octet_length(x) == F.length(x)
    passages = F.when(ascii_(body), F.split(body, _ASCII_PASSAGE)).otherwise(F.split(body, _PASSAGE))
    tokens = lambda p: F.when(ascii_(p), F.regexp_extract_all(p, F.lit(_ASCII_TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(_TOKEN), F.lit(0)))
    number = lambda w: w < ":"  # no token begins with a character before 0
    bucket = lambda w: F.when(number(w), F.length(w)).otherwise(_bucket(w))
    begin = lambda t: F.transform(F.slice(t, 1, 1), lambda w: _bucket(F.concat(F.lit("^"), F.when(number(w), "0").otherwise(w))))
    words = lambda t: F.array_distinct(F.concat(F.transform(t, bucket), begin(t)))
    return F.transform(F.filter(F.transform(passages, tokens), lambda t: F.size(t) > 0), words)


def names_in(slot: Column) -> Column:
    """All names, in lower case, that a slot of any shape can be read as: of {owner.first} also owner, of [insert owner] also insert."""
    body = F.regexp_replace(slot, r"(?i)^(?:&lt;|[^\p{L}])+", "")
    run = F.regexp_extract(body, f"^{_NAME}", 0)
    bare = F.regexp_replace(run, r"_+$", "")
    to = lambda n: F.sequence(F.lit(1), n)
    # Where one may end inside a run of letters: not within a word or number, but anywhere in Han text.
    inside = r"[\p{L}&&[^\p{IsHan}]]{2}|\p{N}{2}"
    starts = F.filter(to(F.length(run)), lambda i: (F.length(body) - i <= 27) & ~F.substring(run, i, F.lit(2)).rlike(f"^(?:{inside})"))
    none = F.array().cast("array<string>")
    inner = F.regexp_replace(slot, "^【|】$", "")
    at = lambda i, j: F.substring(F.concat(F.lit(" "), inner, F.lit(" ")), i + 1, F.length(inner) - i - j + 3)  # with a character on each side
    framed = F.flatten(F.transform(to(F.lit(9)), lambda i: F.transform(to(F.lit(9)), lambda j: at(i - 1, j - 1))))
    whole = lambda x: x.rlike(f"(?s)^.{_NAME}.$") & ~x.rlike(rf"(?s)^(?:{inside})|(?:{inside})$")
    blank = F.regexp_replace(body, r"[:：]?\s*_+\)?$", "")
    found = F.concat(
        F.array(run, bare),
        F.when(slot.startswith("["), F.array(F.regexp_extract(body, rf"^[A-Za-z:]{{3,12}}\s+({_NAME})(?=[\s\]])", 1), F.regexp_extract(body, f"^请?填写({_NAME})", 1))).otherwise(none),
        F.when(slot.startswith("<"), F.array(F.regexp_replace(run, "(?i)^YOUR_", ""))).otherwise(none),
        F.when(slot.startswith("{"), F.transform(starts, lambda i: F.substring(run, F.lit(1), i))).otherwise(none),
        F.when(slot.startswith("__"), F.split(bare, "__")).otherwise(none),
        F.when(slot.startswith("【"), F.transform(F.filter(framed, whole), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(none),
        F.when(slot.rlike(r"___\)?$"), F.array(blank, F.regexp_extract(blank, r"[^.-]+$", 0))).otherwise(none),
    )
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda n: n != ""))


def slots_of(bare: Column) -> Column:
    """Whatever stands in the shape of a slot, with any name; shapes that may hold others are looked for one by one. bare is a text without code."""
    none = F.array().cast("array<string>")
    blank = F.when(bare.contains("____"), F.regexp_extract_all(bare, F.lit(_BLANK), F.lit(0))).otherwise(none)
    found = F.concat(*(F.regexp_extract_all(bare, F.lit(f"(?i)(?:{p})"), F.lit(0)) for p in (_CLEAR, *_SHAPES)), blank)
    # Most texts fail the first test, and most others the second.
    holds = bare.rlike(f"(?i)(?={_OPENER})(?:" + "|".join((_CLEAR, *_SHAPES)) + ")") | (bare.contains("____") & bare.rlike(_BLANK))
    return F.when(bare.rlike(_OPENER), F.when(holds, F.array_distinct(found)))


def without_code(text: Column) -> Column:
    code = text.contains("`") | text.contains("~~~") | text.rlike(r"(?m)^(?: {4}|\t)")
    return F.when(code, F.regexp_replace(text, _CODE, " ")).otherwise(text)


def evidence(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, t, f): for each body of a text, and each reading of its slots, whether it is trusted and the buckets of its passages."""
    body = lambda b: F.struct(trusted_body(b).alias("t"), features_of(b).alias("f"))
    read = lambda name, t: F.struct(F.lit(t).alias("t"), F.array(F.array(_name_bucket(name), *([F.lit(UNMISTAKABLE)] if t else []))).alias("f"))
    clear = f"(?i)^(?:{_CLEAR})$"
    name = lambda s: F.lower(F.regexp_replace(s, clear, "$1$2$3$4$5$6$7$8"))
    trusted = F.transform(F.filter("_slots", lambda s: s.rlike(clear)), name)
    others = F.array_distinct(F.flatten(F.transform(F.filter("_slots", lambda s: ~s.rlike(clear)), names_in)))
    slots = F.concat(F.transform(F.array_distinct(trusted), lambda n: read(n, True)), F.transform(F.array_except(others, trusted), lambda n: read(n, False)))
    none = F.array().cast("array<struct<t:boolean,f:array<array<int>>>>")
    x = df.where(F.col(text).isNotNull()).select(F.col(key), F.lower(F.col(text)).alias("_low"))  # a column first: without_code names it five times
    x = x.select(key, without_code(F.col("_low")).alias("_bare")).withColumn("_slots", slots_of(F.col("_bare")))
    each = F.concat(F.transform(bodies_of(F.col("_bare")), body), F.when(F.col("_slots").isNotNull(), slots).otherwise(none))
    return x.select(key, F.explode(each).alias("_e")).select(key, "_e.t", "_e.f").where(F.size("f") > 0)


def _shared(df: DataFrame, weights: np.ndarray) -> Broadcast:
    """A broadcast of the weights that are not 0, at most SIZE of them."""
    some = np.flatnonzero(weights)
    return df.sparkSession.sparkContext.broadcast((some.astype(np.int32), weights[some].astype(np.float32)))


def _dense(model: Broadcast) -> np.ndarray:
    out = np.zeros(SIZE, np.float32)
    out[model.value[0]] = model.value[1]
    return out


def _scored(lists: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of bodies: the words, the passage of each word, the body of each passage, by body the best and the least score, whether it is a slot."""
    passages = lists.flatten()
    words = passages.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(passages).to_numpy(zero_copy_only=False)
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row, body = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(count)), count)
    score = np.bincount(row, weights[words], len(size))
    first = np.cumsum(count) - count
    slot = words[np.minimum((np.cumsum(size) - size)[first], max(len(words) - 1, 0))] >= BUCKETS if len(words) else np.zeros(len(count), bool)
    return words, row, body, np.maximum.reduceat(score, first), np.minimum.reduceat(score, first), slot


def sums(evidence: DataFrame, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """How many passages hold each bucket, the mass of residue among them, and both of all passages that are no slots.

    Without weights only trusted bodies and slots are residue; with weights an unlabelled one is as far as its scores say so, and how many
    hold each bucket is not counted again.
    """
    first, model = weights is None, _shared(evidence, np.zeros(0) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _dense(model)
        counts, yes, totals = np.zeros(SIZE), np.zeros(SIZE), np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            fixed = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            words, row, body, best, least, slot = _scored(batch.column(1), w)
            odds = np.where(slot, best, np.minimum(best - SURE, least - ORDINARY + SLACK))
            mass = np.where(fixed, 1.0, 0.0 if first else 1 / (1 + np.exp(-np.clip(odds, -30, 30))))[body]
            mass[mass < FAINT] = 0.0
            if first:
                counts += np.bincount(words, minlength=SIZE)
            some = mass[row] > 0
            np.add.at(yes, words[some], mass[row][some])
            text = ~slot[body]
            totals += text.sum(), mass[text].sum()
        some = np.flatnonzero(counts if first else yes)
        b = pa.array(np.append(some, -1), pa.int32())
        yield pa.RecordBatch.from_arrays([b, pa.array(np.append(counts[some], totals[0])), pa.array(np.append(yes[some], totals[1]))], names=["b", "n", "yes"])

    found = evidence.select("t", "f").mapInArrow(run, "b int, n double, yes double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).toArrow()
    model.destroy()
    counts, yes, b = np.zeros(SIZE + 1), np.zeros(SIZE + 1), found["b"].to_numpy()
    counts[b], yes[b] = found["n"].to_numpy(), found["yes"].to_numpy()  # -1 is the last
    return counts[:-1], yes[:-1], float(counts[-1]), float(yes[-1])


def weigh(counts: np.ndarray, yes: np.ndarray, n: float, mass: float) -> np.ndarray:
    """Weights of all buckets from sums().

    A word weighs log P(w | residue) / P(w | other), drawn to 0 by RATE. A name, and the unmistakable
    shape, weigh their log odds, the prior included: residue against the rest, with one ordinary slot that nobody saw.
    """
    no = np.maximum(counts - yes, 0)
    words = np.log((yes / max(mass, 1.0) + RATE) / (no / max(n - mass, 1.0) + RATE))
    names = np.log((yes + 0.1) / (no + 1.0))
    names[UNMISTAKABLE] = np.log((yes[UNMISTAKABLE] + 0.1) / (no[UNMISTAKABLE] + 0.1))  # a single one is enough
    weights = np.clip(np.concatenate((words[:BUCKETS], names[BUCKETS:])), -CLIP, CLIP)
    return np.where(counts > 0, weights, 0.0)


def learn(evidence: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The weights of all buckets by expectation-maximization over all passages of the corpus."""
    counts, yes, n, mass = sums(evidence, None)
    weights, taught = weigh(counts, yes, n, mass), mass > 0
    for _ in range(rounds - 1):
        _, yes, n, mass = sums(evidence, weights)
        weights = weigh(counts, yes, n, mass)
        if not taught:  # no body is trusted: nothing says what residue looks like, and no word may come to mean it by itself
            weights[:BUCKETS] = -CLIP
    return weights


def decide(evidence: DataFrame, key: str, weights: np.ndarray) -> DataFrame:
    """Rows (key,) of texts with a body that has a residue passage and no ordinary one, or with a slot that is left unfilled."""
    model = _shared(evidence, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _dense(model)
        for batch in batches:
            if batch.num_rows:
                _, _, _, best, least, slot = _scored(batch.column(1), w)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(np.where(slot, best > SLOT, (best > SURE) & (least >= ORDINARY))))], names=[key])

    kind = evidence.schema[key].dataType.simpleString()
    return evidence.select(key, "f").mapInArrow(run, f"`{key}` {kind}").dropDuplicates()


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key,) of the texts that are residue in whole or in a section, or have an unfilled slot."""
    seen = cut(evidence(df, key, text))  # narrow, and all that the rounds and the decision read
    return decide(seen, key, learn(seen))
