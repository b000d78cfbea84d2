"""A stated query set against all rows, in blocks: every task scores its rows against the queries and keeps the best of each.

The query set is cut into blocks of at most LIMIT queries; a block is broadcast, and the corpus is scanned once for it and never shuffled.
In a task the queries of a block are scored some at a time, so that no matrix has more than CELLS cells. What leaves a task are at most k
rows for each query and batch, from which the final ranking is taken.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

#: Most queries of a block.
LIMIT = 20_000
#: Most cells of a matrix of rows and queries.
CELLS = 4_000_000


def query_blocks(queries: DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """The query set, block by block, on the driver: one block if it is small enough, else by the hash of the key."""
    n = queries.count()
    blocks = 1 if n <= LIMIT else -(-2 * n // LIMIT)
    for b in range(blocks):
        out = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)).toPandas()
        if len(out):
            yield out.sort_values(key, kind="stable").reset_index(drop=True)


def united(found: list[DataFrame], df: DataFrame, key: str, queries: DataFrame, query_key: str) -> DataFrame:
    """The results of all blocks; without any, an empty table."""
    if not found:
        kinds = [x.schema[c].dataType.simpleString() for x, c in ((queries, query_key), (df, key))]
        return df.sparkSession.createDataFrame([], f"query_id {kinds[0]}, {key} {kinds[1]}, score double, rank int")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


Scorer = Callable[[pd.DataFrame], Callable[[slice], np.ndarray]]


def best_in_blocks(df: DataFrame, key: str, kind: str, ids: list, query_kind: str, score: Scorer, k: int, digits: int = 6, above: float | None = None, rows: int = 10_000) -> DataFrame:
    """Rows (query_id, key, score, rank): the k best rows of df for each query, by score (rounded) and then by key.

    score takes a batch of n rows and gives a function from a slice of ids to an n x len(slice) matrix. With above, rows that do not score
    more are left out.
    """
    step = max(1, CELLS // rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.asarray(ids, dtype=object if query_kind == "string" else None)
        for batch in batches:
            for first in range(0, len(batch), rows):
                some = batch.iloc[first : first + rows].sort_values(key, kind="stable").reset_index(drop=True)
                part = score(some)
                for at in range(0, len(ids), step):
                    s = np.round(part(slice(at, at + step)), digits) + 0.0
                    if len(s) > 4 * k:  # the k-th best score first, then only rows that reach it
                        least = -np.partition(-s, k - 1, axis=0)[k - 1]
                        q, row = np.nonzero((s >= least).T)
                    else:
                        q, row = (x.ravel() for x in np.indices(s.shape[::-1]))
                    order = np.lexsort((row, -s[row, q], q))
                    q, row = q[order], row[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, row = q[place < k], row[place < k]
                    out = pd.DataFrame({"query_id": names[at + q], key: some[key].to_numpy()[row], "score": s[row, q]})
                    yield out if above is None else out[out["score"] > above]

    best = df.mapInPandas(run, f"query_id {query_kind}, {key} {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
