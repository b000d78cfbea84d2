"""Problem 6: encoding a corpus with a byte-level BPE vocabulary, exactly, word by word, by prefix states.

Spark splits each text into words in the JVM. A task sees its words as Arrow columns: only words that are new to it are encoded, the rest is
a dictionary lookup of whole columns. New words are visited in sorted order, which is the depth-first order of their trie. The
state of a prefix is its last token: the one token that ends there, and that the merges keep apart from the last token before it. A word
takes over the states of the prefix that it shares with the word before, so these are computed once.

Defined results: a null and an empty text give an empty list; a text of white space is encoded like any other; ids of special
tokens never appear, their strings are ordinary text; texts of any length are encoded whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words that a task remembers before it starts anew: bounds its memory, changes no result.
REMEMBERED = 300_000

# White space as the pattern of the vocabulary means it.
SPACE = "\\t\\n\\x0b\\f\\r \\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pattern that splits text before the merges of this vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files, by letter."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Byte-level BPE of words through the last-token states of their prefixes."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in pairs}
        ids = {t: i for t, i in model["vocab"].items() if t in raw and (t in made or len(raw[t]) == 1)}
        self.size = {i: len(raw[t]) for t, i in ids.items()}
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        # What a token is made of at its right and at its left edge, smallest part first, with the rank of the merge that takes each part up.
        self.right: dict[int, list[tuple[int, int]]] = {i: [] for i in ids.values()}
        self.left: dict[int, list[tuple[int, int]]] = {i: [] for i in ids.values()}
        for r, (a, b) in enumerate(pairs):
            whole, a, b = ids[a + b], ids[a], ids[b]
            self.right[whole] = [*self.right[b], (b, r)]
            self.left[whole] = [*self.left[a], (a, r)]
        # Tokens by their bytes from the last to the first: node -> byte -> node, and the token that ends the walk there.
        self.step: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ids.items():
            at = 0
            for b in reversed(raw[t]):
                if b not in self.step[at]:
                    self.step[at][b] = len(self.step)
                    self.step.append({})
                    self.token.append(-1)
                at = self.step[at][b]
            self.token[at] = i
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b, side by side, as they are: no part at the seam is merged across it before both are whole."""
        never = 1 << 40
        x, y = [*self.right[a], (a, never)], [*self.left[b], (b, never)]
        i = j = 0
        while True:
            (p, p_end), (q, q_end) = x[i], y[j]
            across = self.rank.get((p, q), never)
            # Equal merges run from left to right: one that ends p comes before the one across the seam, one that ends q after it.
            if across < p_end and across <= q_end and across < never:
                return False
            if p_end == q_end == never:
                return True
            if p_end <= q_end:
                i += 1
            else:
                j += 1

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; words are sorted, so that each shares its longest possible prefix with the one before."""
        out, last, before = [], [], b""
        step, token, size, apart = self.step, self.token, self.size, self.apart
        for word in words:
            most = min(len(before), len(word))
            shared = next((k for k in range(most) if before[k] != word[k]), most)
            del last[shared:]
            for end in range(shared, len(word)):
                ends, at, k = [], 0, end
                while k >= 0 and (at := step[at].get(word[k], 0)):
                    if token[at] >= 0:
                        ends.append(token[at])
                    k -= 1
                for t in reversed(ends):
                    start = end + 1 - size[t]
                    if start == 0:
                        # Alone at the start: it must be what its own bytes merge into, which holds for every token made by a merge.
                        last.append(t)
                        break
                    pair = (last[start - 1], t)
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self.stay_apart(*pair)
                    if ok:
                        last.append(t)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(last[end - 1])
                end -= size[ids[-1]]
            out.append(ids[::-1])
            before = word
        return out


def words_of(text: Column) -> Column:
    """The words of a text in the sense of PATTERN; null where the text holds code points that this JVM does not know yet."""
    known = ~text.rlike(r"\p{Cn}")
    return F.when(known, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (key, ids) for every row of df. The vocabulary file is read here once and broadcast: its size does not depend on the data."""
    with open(vocabulary, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers.pre_tokenizers import ByteLevel

        coder, splitter = None, ByteLevel(add_prefix_space=False, use_regex=True)
        split = lambda text: [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]
        seen: dict[str, int] = {}
        found: list[list[int]] = []
        for batch in batches:
            coder = coder or PrefixEncoder(model.value)
            words, rest = batch.column(1), batch.column(2)
            if rest.null_count < len(rest):  # texts with code points newer than the JVM are split here
                words = pa.array([w if r is None else split(r) for w, r in zip(words.to_pylist(), rest.to_pylist(), strict=True)], pa.list_(pa.string()))
            flat = words.flatten()
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(seen) > REMEMBERED:
                seen, found = {}, []
            new = sorted((w.encode(), w) for w in distinct if w not in seen)
            for (_, w), ids in zip(new, coder.encode_sorted([b for b, _ in new]), strict=True):
                seen[w] = len(found)
                found.append(ids)
            ids = [found[seen[w]] for w in distinct]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            table = np.fromiter((x for one in ids for x in one), np.int32, ends[-1])
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(ends)[which]
            starts = np.cumsum(np.concatenate(([0], n)))
            put = np.repeat(ends[:-1][which] - starts[:-1], n) + np.arange(starts[-1])
            count = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            offsets = starts[np.concatenate(([0], np.cumsum(count)))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(table[put], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    words = words_of(F.col(text))
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), words.alias("_words"), F.when(F.col(text).isNotNull() & words.isNull(), F.col(text)).alias("_rest")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
