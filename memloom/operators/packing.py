"""Budgeted selection: items in priority order, each taken if it still fits; one that does not fit uses nothing up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_within_budget(df: DataFrame, group: str, rank: str, item: str, cost: str, budget: int, most: int = 1000) -> DataFrame:
    """Rows (group, item, used) of the taken items, used being the budget spent up to and including the item.

    The selection depends on the order, so a group is folded in one row; groups are ranked lists with at most `most` entries (later ranks are
    not candidates, as in any coarse ranking). Null and negative costs count as 0.
    """
    price = F.greatest(F.coalesce(F.col(cost), F.lit(0)), F.lit(0)).cast("long")
    lists = df.where(F.col(rank) <= most).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("item"), price.alias("cost")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<item:%s,used:bigint>>" % df.schema[item].dataType.simpleString()).alias("taken"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= budget
        taken = F.struct(x["item"].alias("item"), (s["used"] + x["cost"]).alias("used"))
        return F.when(fits, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["taken"], F.array(taken)).alias("taken"))).otherwise(s)

    return lists.select(group, F.explode(F.aggregate("l", start, step, lambda s: s["taken"])).alias("t")).select(group, "t.item", "t.used")
