"""Problem 2: records whose word sets are similar, found through a token-group matrix.

classes   Records with equal word sets are one class; only classes are compared. Words become 64-bit tokens of their field.
groups    Classes are put in order by their rarest words and cut into groups of GROUP classes. A row of the matrix is a group: its members
          and the union of their tokens.
tried     A class tries the groups with which it shares a key (see _keys); none that holds a similar class of its size or smaller is left out.
bound     |q ∩ U| >= t |q| for the group's union U, or no member can be similar: only qualifying groups are opened.
check     The words in both by the words in either, exactly.

Keys. Of two similar classes the larger shares at least t |q| of its words, so among its |q| - ceil(t |q|) + 2 first ones in any fixed
order two are shared; the smaller one needs only its |s| - ceil(2t / (1 + t) |s|) + 2 first ones. The order puts rare words first (by the
counts of word buckets, of a fixed number). A shared word that at most RARE classes hold is a key by itself, two others are one together.
Sets of more than LONG words take single words only, so that keys grow with the length and not with its square; near that length both.

Joins. Tables of classes, groups and records grow with the input, and Spark would broadcast them by the size of their files, which is a small part of
what they take in memory where texts repeat. So all joins are merge joins, of which no side goes through the driver.

Defined results: a null text and one without words have no class and no pair; repeated rows change nothing; ties do not matter as no
candidate is capped; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import word_set
from memloom.session import cut, forget

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

#: Buckets of the counts that order the words (4 MB broadcast).
BUCKETS = 1 << 20
#: Classes of a group.
GROUP = 16
#: Most classes with a word that is a key by itself.
RARE = 8
#: Words of a set from which on single words are keys.
LONG = 64


def classes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (record, cls, tokens): every record's class in every field. cls is a digest of the field and the set."""
    made = [F.struct(F.lit(f).alias("field"), word_set(F.col(f)).alias("words")) for f in fields]
    x = df.select(F.col(key).alias("record"), F.explode(F.array(*made)).alias("x")).where(F.size("x.words") > 0)
    digest = F.unhex(F.md5(F.concat_ws(" ", F.col("x.field"), F.col("x.words")).cast("binary")))
    return x.select("record", digest.alias("cls"), F.transform("x.words", lambda w: F.xxhash64(F.col("x.field"), w)).alias("tokens"))


def _counts(rows: DataFrame) -> np.ndarray:
    """In how many rows a word of each bucket occurs."""
    found = rows.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(BUCKETS)).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[found["b"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    return out


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast."""
    return df.hint("merge")


def _need(size: Column, threshold: float) -> Column:
    """The fewest words of a set of this size that a similar set of its size or smaller shares."""
    return F.ceil(F.round(size * threshold, 9)).cast("int")


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.round(x, 9)).astype(np.int64)


def _ordered(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows (cls, tokens, rare, lead): the tokens with rare words first, how many are rare, and the first one."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            row, n = np.repeat(np.arange(len(size)), size), shared.value[flat % BUCKETS]
            order = np.lexsort((flat, n, row))
            rare = np.bincount(row, n <= RARE, len(size)).astype(np.int32)
            ends = np.cumsum(size)
            flat = flat[order]
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(rare), pa.array(flat[ends - size])], names=["cls", "tokens", "rare", "lead"])

    return sets.select("cls", "tokens").mapInArrow(run, "cls binary, tokens array<bigint>, rare int, lead bigint")


def matrix(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows (grp, at, cls, tokens, rare): the classes in groups of GROUP that follow each other in the order of their rarest words."""
    x = _ordered(sets, counts).hint("rebalance", "lead").sortWithinPartitions("lead", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            at = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            grp = (np.int64(TaskContext.get().partitionId()) << 40) + at // GROUP
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array((at % GROUP).astype(np.int32)), *(batch.column(i) for i in range(3))], names=["grp", "at", "cls", "tokens", "rare"])

    return x.select("cls", "tokens", "rare").mapInArrow(run, "grp bigint, at int, cls binary, tokens array<bigint>, rare int")


def _keys(members: DataFrame, threshold: float, larger: bool) -> DataFrame:
    """Rows (key, grp, at) of each class as the larger or as the smaller one of a pair."""

    def pick(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions first .. first + count - 1 of every row, and their rows."""
        count = np.maximum(count, 0)
        row = np.repeat(np.arange(len(count)), count)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, size = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(flat):
                continue
            begin, rare = np.cumsum(size) - size, batch.column(3).to_numpy(zero_copy_only=False)
            need = _ceil(size * (threshold if larger else 2 * threshold / (1 + threshold)))
            first = np.minimum(size - need + 2, size)  # two of these are shared, if two are at all
            alone = np.minimum(rare, first)
            alone = np.where((need < 2) | (size >= threshold * LONG), np.maximum(alone, size - need + 1), alone)
            row, at = pick(begin, alone)
            rows, keys = [row], [flat[at]]
            paired = np.where(size <= LONG / threshold, first - np.minimum(rare, first), 0)
            for k in np.unique(paired[paired > 1]):
                some = np.flatnonzero(paired == k)
                a, b = np.triu_indices(k, 1)
                left = (begin[some] + rare[some])[:, None]
                rows.append(np.repeat(some, len(a)))
                keys.append((flat[left + a] * np.uint64(0x9E3779B97F4A7C15) + flat[left + b] * np.uint64(0xC2B2AE3D27D4EB4F)).ravel())
            row, key = np.concatenate(rows), np.concatenate(keys).view(np.int64)
            for some in np.array_split(np.arange(len(row)), len(row) // 200_000 + 1):  # bounded batches out
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), batch.column(0).take(at), batch.column(1).take(at), pa.array(size[row[some]].astype(np.int32))], names=["key", "grp", "at", "size"])

    return members.select("grp", "at", "tokens", "rare").mapInArrow(run, "key bigint, grp bigint, at int, size int")


def tried_groups(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (q_grp, q_at, grp): the groups that a class shares a key with, the class as the larger one."""
    columns = _keys(members, threshold, False).groupBy("key", "grp").agg(F.min("size").alias("_least"))
    asked = _keys(members, threshold, True).select("key", F.col("grp").alias("q_grp"), F.col("at").alias("q_at"), "size")
    return asked.join(_large(columns), "key").where("_least <= size").select("q_grp", "q_at", "grp").dropDuplicates()


def qualifying_groups(tried: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Rows (q, q_tokens, in_group) of the tried groups whose union holds enough of the class's tokens."""
    groups = members.groupBy("grp").agg(F.collect_list(F.struct("cls", "tokens")).alias("in_group"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    asked = members.select(F.col("grp").alias("q_grp"), F.col("at").alias("q_at"), F.col("cls").alias("q"), F.col("tokens").alias("q_tokens"))
    x = tried.join(_large(asked), ["q_grp", "q_at"]).join(_large(groups), "grp")
    return x.where(F.size(F.array_intersect("q_tokens", "union")) >= _need(F.size("q_tokens"), threshold)).select("q", "q_tokens", "in_group")


def similar_classes(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, similarity): the pairs of classes that are similar enough, each once. members: see matrix."""
    opened = qualifying_groups(tried_groups(members, threshold), members, threshold).select("q", "q_tokens", F.explode("in_group").alias("m"))
    n, m = F.size("q_tokens"), F.size("m.tokens")
    opened = opened.where((m < n) | ((m == n) & (F.col("m.cls") < F.col("q")))).where(m >= _need(n, threshold))
    both = F.size(F.array_intersect("q_tokens", "m.tokens"))
    x = opened.select(F.col("q").alias("a"), F.col("m.cls").alias("b"), (both / (n + m - both)).alias("similarity"))
    return x.where(F.col("similarity") >= threshold)


def _compared(df: DataFrame, key: str, fields: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """The members (cls, record), each once, and the similar pairs of classes (a, b), both written."""
    rows = cut(classes(df, key, fields))
    sets = cut(matrix(rows.groupBy("cls").agg(F.first("tokens").alias("tokens")), _counts(rows)))
    members = cut(rows.select("cls", "record").dropDuplicates())
    pairs = cut(similar_classes(sets, threshold).select("a", "b"))
    forget(rows, sets)
    return members, pairs


def similar_records(df: DataFrame, key: str, fields: list[str], threshold: float) -> DataFrame:
    """Rows (a, b), a < b: different records that are similar in one of the fields."""
    members, pairs = _compared(df, key, fields, threshold)
    left, right = members.select(F.col("cls").alias("a"), F.col("record").alias("x")), members.select(F.col("cls").alias("b"), F.col("record").alias("y"))
    across = pairs.join(_large(left), "a").join(_large(right), "b").select("x", "y")
    within = members.withColumnRenamed("record", "x").join(_large(members.withColumnRenamed("record", "y")), "cls").where("x < y").select("x", "y")
    both = across.where("x != y").unionByName(within)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).dropDuplicates()


def linked_records(df: DataFrame, key: str, fields: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """The same links without their pairs: edges (a, b) that join the same records, and rows (record, links).

    The records of a class are joined in a star with its smallest one, and similar classes by their smallest ones. links counts the similar
    records of the same field and class and of other classes; a record that is similar in several fields counts once for each.
    """
    members, pairs = _compared(df, key, fields, threshold)
    size = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("record").alias("least"))
    star = members.join(_large(size.where("n > 1")), "cls").where("record != least").select(F.col("least").alias("a"), F.col("record").alias("b"))
    left, right = size.select(F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("least").alias("x")), size.select(F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("least").alias("y"))
    ends = pairs.join(_large(left), "a").join(_large(right), "b")
    near = ends.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("cls"), F.col("a_n").alias("n")))).alias("e"))
    more = size.select("cls", (F.col("n") - 1).alias("n")).unionByName(near.select("e.cls", "e.n")).groupBy("cls").agg(F.sum("n").alias("links"))
    links = members.join(_large(more), "cls").groupBy("record").agg(F.sum("links").alias("links")).where("links > 0")
    return star.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a != b").dropDuplicates(), links
