"""Problem 4: overlapping and gapped intervals per entity, merged into continuous periods, with the gaps between them.

session_window with a duration taken from each row merges the intervals of a key natively, but a key is one task. So a key with more than
ROWS intervals is cut into slices of its time, as many as its rows ask for, and merged per slice. At the seams one row per slice says how
far the slices before it reach: what lies within that is dropped, what juts out begins there. The parts that are left never overlap, so
lead(start) after a part tells whether a gap follows or the period goes on.

Defined results: an interval with a null bound or whose end is not after its start is ignored, as is one with a null key; repeated
intervals change nothing; an empty table gives empty results; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.slices import lead_across
from memloom.session import cut

#: Intervals of a key that may be one task: a parameter that only spreads the work.
ROWS = 100_000


def axis_intervals(df: DataFrame, entity: str, axes: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows (entity_id, axis, start_us, end_us) of every named pair of timestamp columns, in one pass over df."""
    pairs = [F.struct(F.lit(a).alias("axis"), F.unix_micros(F.col(s)).alias("s"), F.unix_micros(F.col(e)).alias("e")) for a, (s, e) in axes.items()]
    x = df.select(F.col(entity).alias("entity_id"), F.explode(F.array(*pairs)).alias("i"))
    return x.select("entity_id", "i.axis", F.col("i.s").alias("start_us"), F.col("i.e").alias("end_us")).where("end_us > start_us")


def _sliced(intervals: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The valid intervals with slice: 0 for a key of at most rows intervals, else the number of its equal stretch of time.

    The hot keys are written once, so that Spark knows their true size: it broadcasts a small table and joins a large one by shuffling.
    """
    x = intervals.where("end_us > start_us").dropna(subset=keys).select(*keys, "start_us", "end_us")
    per = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("start_us").alias("_from"), F.max("start_us").alias("_to")).where(F.col("_n") > rows)
    hot = cut(per.select(*keys, "_from", F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from") + 1) / F.ceil(F.col("_n") / rows))).alias("_width")))
    at = F.floor((F.col("start_us") - F.col("_from")) / F.col("_width"))
    return x.join(hot, keys, "left").withColumn("slice", F.coalesce(at, F.lit(0))).drop("_from", "_width")


def merge_in_slices(intervals: DataFrame, keys: list[str], rows: int = ROWS) -> DataFrame:
    """Rows (keys, slice, start_us, end_us): per key and slice of the start, the overlapping intervals as one."""
    length = F.col("end_us") - F.col("start_us")
    micros = F.make_interval(secs=(length.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return (
        _sliced(intervals, keys, rows)
        .groupBy(*keys, "slice", F.session_window(F.timestamp_micros("start_us"), micros).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(*keys, "slice", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"))
    )


def _parts(intervals: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows (keys, slice, start_us, end_us, next_us) that do not overlap, however the slices do; next_us is where the next one of the key starts."""
    merged = merge_in_slices(intervals, keys, rows)
    reach = merged.groupBy(*keys, "slice").agg(F.max("end_us").alias("_reach"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    seams = reach.select(*keys, "slice", F.max("_reach").over(before).alias("_before"))
    x = merged.join(seams, [*keys, "slice"]).where("_before IS NULL OR end_us > _before")
    x = x.select(*keys, "slice", F.greatest("start_us", "_before").alias("start_us"), "end_us")
    return lead_across(x, keys, F.col("start_us"), "start_us", "next_us")


def gaps(intervals: DataFrame, keys: list[str], rows: int = ROWS) -> DataFrame:
    """Rows (keys, gap_start_us, gap_end_us): the holes between two periods of a key. Touching periods leave none."""
    return _parts(intervals, keys, rows).where("next_us > end_us").select(*keys, F.col("end_us").alias("gap_start_us"), F.col("next_us").alias("gap_end_us"))


def periods(intervals: DataFrame, keys: list[str], rows: int = ROWS) -> DataFrame:
    """Rows (keys, start_us, end_us): the continuous periods of a key. One ends at each gap and where the key ends; the next begins after the gap."""
    ends = _parts(intervals, keys, rows).withColumn("_end", (F.col("next_us") > F.col("end_us")) | F.col("next_us").isNull())
    first = ends.groupBy(*keys).agg(F.min("start_us").alias("start_us"), F.min(F.when(F.col("_end"), F.col("end_us"))).alias("end_us"))
    closed = lead_across(ends.where("_end"), keys, F.col("end_us"), "end_us", "_close")
    return first.unionByName(closed.where("next_us IS NOT NULL").select(*keys, F.col("next_us").alias("start_us"), F.col("_close").alias("end_us")))
