"""Exact batches of a shuffled epoch, without a sort of all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of a row's digest that name its bucket: each holds a 4,096th of the rows.
DIGITS = 3


def epoch_batches(rows: DataFrame, keys: Sequence[str], batch_size: int, epoch: int = 0, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """Adds ``batch``: 0, 1, ... in the order of a digest of (seed, epoch, keys), another order each epoch.

    Every row is in one batch, and all but the last have ``batch_size`` rows; ``drop_last``
    leaves a shorter last one out.  ``keys`` tell rows apart; rows alike in them follow
    each other.  A row's place is the number of rows in the buckets before its own, whose
    counts are a small table, and its rank within its bucket.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *(F.col(k).cast("string") for k in keys)))
    named = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, DIGITS))
    counts = named.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest"))
    placed = named.join(F.broadcast(offsets), "_bucket").withColumn("batch", F.floor((F.col("_before") + rank - 1) / batch_size).cast("int"))
    if drop_last:
        placed = placed.where(F.col("batch") < F.floor(F.col("_all") / batch_size))
    return placed.drop("_digest", "_bucket", "_before", "_all")
