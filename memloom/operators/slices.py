"""Order-dependent work on keys of any size: rows of a key are spread over slices of the order, and one row per slice crosses between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lead_across(df: DataFrame, keys: list[str], value: Column, order: str, name: str) -> DataFrame:
    """Adds lead(value) in the order of a key: inside a slice by a window, at its end from the next slice that has rows.

    df has a column slice that never decreases along the order. Null values of the next row come out as if that row's slice had ended, so
    value should not be null where the difference matters.
    """
    inside = Window.partitionBy(*keys, "slice").orderBy(order)
    first = df.groupBy(*keys, "slice").agg(F.min_by(value, F.col(order)).alias("_first"))
    following = first.select(*keys, "slice", F.lead("_first").over(Window.partitionBy(*keys).orderBy("slice")).alias("_after"))
    return df.withColumn("_in", F.lead(value).over(inside)).join(following, [*keys, "slice"]).withColumn(name, F.coalesce("_in", "_after")).drop("_in", "_after")


def running_sum(df: DataFrame, keys: list[str], value: Column, order: str, name: str) -> DataFrame:
    """Adds the sum of value over the earlier rows of the key (not this one), by slices: a window inside a slice, plus what the slices before it sum to."""
    before = Window.partitionBy(*keys, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "slice").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "slice", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_off"))
    x = df.withColumn("_in", F.coalesce(F.sum(value).over(before), F.lit(0))).join(offsets, [*keys, "slice"])
    return x.withColumn(name, F.col("_in") + F.col("_off")).drop("_in", "_off")


def last_across(df: DataFrame, keys: list[str], value: Column, order: str, name: str) -> DataFrame:
    """Adds the last value that is not null of the earlier rows of the key (not this one), by slices as above."""
    before = Window.partitionBy(*keys, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    final = df.groupBy(*keys, "slice").agg(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias("_final"))
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = final.select(*keys, "slice", F.last("_final", ignorenulls=True).over(over).alias("_earlier"))
    x = df.withColumn("_in", F.last(value, ignorenulls=True).over(before)).join(earlier, [*keys, "slice"])
    return x.withColumn(name, F.coalesce("_in", "_earlier")).drop("_in", "_earlier")
