"""Synthetic panels.  All randomness is seeded by entity, so partitioning doesn't matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters of the priors (beta, beta, normal, lognormal).
TO_CONFLICT, TO_PEACE, LOG_MEAN, LOG_SIGMA = (2, 20), (5, 1), (0.5, 0.3), (0.0, 0.5)


def clustered_timeline(n: int, to_conflict: float, to_peace: float, mean: float, sigma: float, seed: int) -> np.ndarray:
    """A two-state Markov chain: zeros in peace, lognormal magnitudes in conflict."""
    rng = np.random.default_rng(seed)
    turns, size = rng.random(n), rng.lognormal(mean, sigma, n)
    state, out = False, np.zeros(n)
    for t in range(1, n):  # the first step is peace
        state = turns[t] < to_conflict if not state else turns[t] >= to_peace
        out[t] = size[t] if state else 0.0
    return out


def clustered_panel(spark: SparkSession, timelines: int = 200, months: int = 300, seed: int = 42, start: str = "2000-01-01") -> DataFrame:
    """(time date, country_id string, target float): each timeline draws its own chain and magnitudes."""

    def make(batches):
        for pdf in batches:
            for i in pdf["id"]:
                rng = np.random.default_rng(seed + int(i))
                chain = rng.beta(*TO_CONFLICT), rng.beta(*TO_PEACE)
                mean, sigma = max(0.01, rng.normal(*LOG_MEAN)), max(0.1, rng.lognormal(*LOG_SIGMA))
                y = clustered_timeline(months, *chain, mean, sigma, seed + int(i))
                yield pd.DataFrame({"i": i, "k": np.arange(months, dtype=np.int32), "target": y.astype(np.float32)})

    rows = spark.range(timelines).mapInPandas(make, "i long, k int, target float")
    day = F.last_day(F.add_months(F.to_date(F.lit(start)), F.col("k")))
    return rows.select(day.alias("time"), F.format_string("country_%03d", "i").alias("country_id"), "target")


def zero_inflated_gamma(spark: SparkSession, n: int, zero_share: float = 0.9, shape: float = 1.5, scale: float = 2.0, seed: int = 42) -> DataFrame:
    """(id, value): zero with a probability, else gamma."""

    @F.pandas_udf("double")
    def draw(ids: pd.Series) -> pd.Series:
        def one(i):
            rng = np.random.default_rng((seed, int(i)))
            return 0.0 if rng.random() < zero_share else rng.gamma(shape, scale)

        return ids.map(one).astype(float)

    return spark.range(n).select("id", draw("id").alias("value"))


def fake_batch(spark: SparkSession, series: int, steps: int, channels: int, sparsity: float = 0.8, top: float = 100.0, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(series, step, channel, y, yhat): sparse uniform truths and predictions with normal noise in proportion."""
    cells = spark.range(series * steps * channels)
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 40)) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(unit(2) + 1e-12)) * F.cos(6.283185307179586 * unit(3))
    y = F.when(unit(0) < sparsity, 0.0).otherwise(unit(1) * top)
    rows = cells.select(F.floor(F.col("id") / (steps * channels)).alias("series"), F.floor(F.col("id") / channels % steps).cast("int").alias("step"), (F.col("id") % channels).cast("int").alias("channel"), y.alias("y"), normal.alias("g"))
    return rows.select("series", "step", "channel", "y", (F.col("y") * (1 + noise * F.col("g"))).alias("yhat"))
