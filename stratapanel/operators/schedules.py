"""Learning-rate schedules and parameter grids as tables."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _warmup(lr: float, low: float, epochs: int) -> Column:
    return low + (lr - low) * (F.col("id") / max(epochs, 1))


def _cosine(start: float, low: float, done: Column) -> Column:
    return low + (start - low) * (1 + F.cos(pi * done)) / 2


def warmup_restarts(spark: SparkSession, epochs: int, lr: float, warmup_epochs: int = 5, t_0: int = 30, t_mult: int = 2, eta_min: float = 0.0) -> DataFrame:
    """(epoch, lr): a linear warm-up, then cosine cycles whose length grows by ``t_mult``."""
    e = F.col("id") - warmup_epochs
    lengths, total = [t_0], t_0
    while total < epochs:
        lengths.append(lengths[-1] * t_mult)
        total += lengths[-1]
    starts = [0, *accumulate(lengths)][: len(lengths)]
    start, length = F.lit(starts[-1]), F.lit(lengths[-1])
    for s, n, after in reversed(list(zip(starts, lengths, starts[1:]))):
        start, length = F.when(e < after, s).otherwise(start), F.when(e < after, n).otherwise(length)
    rate = F.when(F.col("id") < warmup_epochs, _warmup(lr, eta_min, warmup_epochs)).otherwise(_cosine(lr, eta_min, (e - start) / length))
    return spark.range(epochs).select(F.col("id").alias("epoch"), rate.alias("lr"))


def warmup_cosine(spark: SparkSession, epochs: int, lr: float, warmup_epochs: int = 10, t_max: int = 300, eta_min: float = 1e-6) -> DataFrame:
    """(epoch, lr): a linear warm-up, then half a cosine down to ``eta_min``, where it stays."""
    done = F.least((F.col("id") - warmup_epochs) / max(t_max - warmup_epochs, 1), F.lit(1.0))
    rate = F.when(F.col("id") < warmup_epochs, _warmup(lr, eta_min, warmup_epochs)).otherwise(_cosine(lr, eta_min, done))
    return spark.range(epochs).select(F.col("id").alias("epoch"), rate.alias("lr"))


def step_decay(spark: SparkSession, epochs: int, lr: float, step_size: int, gamma: float) -> DataFrame:
    return spark.range(epochs).select(F.col("id").alias("epoch"), (lr * F.pow(F.lit(gamma), F.floor(F.col("id") / step_size))).alias("lr"))


def exponential_decay(spark: SparkSession, epochs: int, lr: float, gamma: float) -> DataFrame:
    return step_decay(spark, epochs, lr, 1, gamma)


def plateau(log: DataFrame, run: str, epoch: str, value: str, lr: float, factor: float, wait: int, min_lr: float) -> DataFrame:
    """(run, epoch, lr): lowered after more than ``wait`` epochs without a new least value.

    A fold over each run's epochs, which are one group, in linear time.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("e", kind="stable")
        best, bad, rate, rates = float("inf"), 0, float(lr), []
        for v in rows["v"]:
            if v < best * (1 - 1e-4):
                best, bad = v, 0
            else:
                bad += 1
            if bad > wait:
                rate, bad = max(rate * factor, min_lr), 0
            rates.append(rate)
        return rows[["r", "e"]].assign(lr=rates)

    kind = log.schema[run].dataType.simpleString()
    rows = log.select(F.col(run).alias("r"), F.col(epoch).cast("bigint").alias("e"), F.col(value).cast("double").alias("v"))
    folded = rows.groupBy("r").applyInPandas(fold, f"r {kind}, e bigint, lr double")
    return folded.select(F.col("r").alias(run), F.col("e").alias(epoch), "lr")


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """All combinations of parameter values, as strings; a product of short lists."""
    tables = [spark.range(1).select(F.explode(F.array(*(F.lit(str(v)) for v in values))).alias(name)) for name, values in parameters.items()]
    return reduce(lambda a, b: a.crossJoin(b), tables)


def random_draws(spark: SparkSession, parameters: dict[str, list], n: int, seed: int) -> DataFrame:
    """``n`` combinations drawn by a hash of trial and name."""
    trials = spark.range(n).withColumnRenamed("id", "trial")
    for name, values in parameters.items():
        options = F.array(*(F.lit(str(v)) for v in values))
        trials = trials.withColumn(name, F.get(options, F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "trial"), F.lit(len(values))).cast("int")))
    return trials
