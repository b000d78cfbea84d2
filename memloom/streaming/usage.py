"""Structured Streaming twins of the batch queries: debounced batches, sessions of use, idempotent events.

The streams read a folder or file of Parquet as it grows; with available_now they run until nothing is new and stop.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.session import _shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package installed

QUIET_S, LONGEST_S, MOST = 20.0, 120.0, 128


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table (a file or a folder), with the schema that it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file will do


def available_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote: a table in the shared folder.

    Progress is in a checkpoint beside the table, so that a restart goes on where it stopped.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{_shared_folder(spark)}/memloom-stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:  # the last complete result replaces the one before
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    query = writer.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Windows of a key's use without a gap: rows (key, start, end, n). With a watermark of `late`, which bounds the state."""
    x = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once within the watermark: redeliveries after it are not remembered."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, key: str, at: str, quiet_s: float = QUIET_S, longest_s: float = LONGEST_S, most: int = MOST) -> DataFrame:
    """Rows (key, first, last, n): batches of a key's events that close after quiet_s without one, longest_s after the first, or with most events.

    State per key is one open batch, kept between micro-batches and closed by event time. Events of a micro-batch are taken in time order.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        open_ = state.get if state.exists else None
        if state.hasTimedOut:
            rows.append(open_)
            state.remove()
        else:
            times = sorted(t for b in batches for t in b[at].astype("int64") // 1000)  # microseconds
            for t in times:
                if open_ and (t - open_[1] > quiet_s * 1e6 or t - open_[0] > longest_s * 1e6 or open_[2] >= most):
                    rows.append(open_)
                    open_ = None
                open_ = (open_[0], t, open_[2] + 1) if open_ else (t, t, 1)
            if open_:
                state.update(open_)
                due = min(open_[1] + quiet_s * 1e6, open_[0] + longest_s * 1e6) // 1000
                state.setTimeoutTimestamp(int(max(due, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame([(group[0], *map(int, r)) for r in rows], columns=[key, "first_us", "last_us", "n"])

    kind = events.schema[key].dataType.simpleString()
    return (
        events.withWatermark(at, "10 minutes")
        .groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind}, first_us long, last_us long, n long", "first_us long, last_us long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )
