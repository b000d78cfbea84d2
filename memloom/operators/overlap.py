"""Range joins by time buckets: Spark has no range join, so both sides are spread over the buckets they touch and joined by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """The pairs of rows with equal keys whose [start_us, end_us) overlap, each once. Right columns other than keys get the prefix r_.

    A pair is taken in the bucket where the later of its two starts lies, so nothing has to be deduplicated. Empty ranges overlap nothing.
    """

    def spread(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("start_us") / width_us), F.floor((F.col("end_us") - 1) / width_us)
        return df.where("end_us > start_us").withColumn("_b", F.explode(F.sequence(first, last)))

    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    r = spread(r.withColumnsRenamed({"r_start_us": "start_us", "r_end_us": "end_us"})).withColumnsRenamed({"start_us": "r_start_us", "end_us": "r_end_us"})
    x = spread(left).join(r, [*keys, "_b"]).where((F.col("start_us") < F.col("r_end_us")) & (F.col("r_start_us") < F.col("end_us")))
    return x.where(F.col("_b") == F.floor(F.greatest("start_us", "r_start_us") / width_us)).drop("_b")
