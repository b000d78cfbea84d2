"""Connected components for deduplication by several keys at once (items that share any key belong together)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import cut, forget


def components_by_keys(rows: DataFrame, item: str, key: str) -> DataFrame:
    """Rows (item, component) with the smallest item reached through shared keys.

    Labels spread from items to keys and back: a round gives every key the smallest label of its items and every item the smallest of its
    keys and of its label's own label, so that labels travel further each round. Groups are only ever aggregated, never collected. Null
    keys and items link nothing; items without a key do not appear.
    """
    links = cut(rows.where(F.col(item).isNotNull() & F.col(key).isNotNull()).select(F.col(item).alias("i"), F.col(key).alias("k")).dropDuplicates())
    labels = cut(links.select("i").dropDuplicates().withColumn("c", F.col("i")))
    while True:
        least = links.join(labels, "i").groupBy("k").agg(F.min("c").alias("c"))
        near = links.join(least, "k").groupBy("i").agg(F.min("c").alias("n"))
        jump = labels.select(F.col("i").alias("n"), F.col("c").alias("j"))
        new = cut(labels.join(near, "i").join(jump, "n").select("i", F.least("c", "n", "j").alias("c"), (F.least("n", "j") < F.col("c")).alias("moved")))
        forget(labels)
        labels = new
        if new.where("moved").isEmpty():
            forget(links)
            return labels.select(F.col("i").alias("item"), F.col("c").alias("component"))
