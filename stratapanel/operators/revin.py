"""Reversible instance normalisation in asinh space, over (series, channel).

Forward: mu is the mean over time, c = sinh(x - mu), sigma the root of its population
variance plus eps, z = asinh(c / sigma).  The inverse caps sigma at a multiple of the
mean sigma of the channel's batch; the batch is all series given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.elementary import asinh, clamp

# Bounds of arguments, and of sigma against its batch mean.
FORWARD_BOUND, INVERSE_BOUND, SIGMA_CAP, EPS = 88.0, 50.0, 5.0, 1e-5


def normalise(df: DataFrame, by: list[str], column: str, eps: float = EPS, weight: float = 1.0, bias: float = 0.0) -> DataFrame:
    """Adds mu, sigma and z; two passes over each series within one shuffle."""
    series = Window.partitionBy(*by)
    out = df.withColumn("mu", F.avg(column).over(series))
    shifted = F.sinh(clamp(F.col(column) - F.col("mu"), -FORWARD_BOUND, FORWARD_BOUND))
    out = out.withColumn("_c", shifted)
    out = out.withColumn("sigma", F.sqrt(F.var_pop("_c").over(series) + eps))
    return out.withColumn("z", asinh(F.col("_c") / F.col("sigma")) * weight + bias).drop("_c")


def denormalise(df: DataFrame, channel: list[str], by: list[str], z: str = "z", weight: float = 1.0, bias: float = 0.0) -> DataFrame:
    """Adds x from z, mu and sigma.  The mean sigma of each channel counts each series once."""
    series = df.select(*by, "sigma").distinct()
    if channel:
        cap = series.groupBy(*channel).agg((F.avg("sigma") * SIGMA_CAP).alias("_cap"))
        out = df.join(cap, channel)
    else:
        out = df.crossJoin(F.broadcast(series.agg((F.avg("sigma") * SIGMA_CAP).alias("_cap"))))  # one row
    inner = F.sinh(clamp((F.col(z) - bias) / weight, -INVERSE_BOUND, INVERSE_BOUND))
    return out.withColumn("x", asinh(inner * F.least("sigma", "_cap")) + F.col("mu")).drop("_cap")


def moments(df: DataFrame, by: list[str]) -> DataFrame:
    """One row: least, greatest and mean mu and sigma over the series, and cv = max sigma / max(|max mu|, 1)."""
    series = df.select(*by, "mu", "sigma").distinct()
    names = [(f, c) for c in ("mu", "sigma") for f in ("min", "max", "avg")]
    found = series.agg(*(getattr(F, f)(c).alias(f"{c}_{f}") for f, c in names))
    return found.withColumn("cv_max", F.col("sigma_max") / F.greatest(F.abs("mu_max"), F.lit(1.0)))
