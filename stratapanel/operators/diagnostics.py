"""Training diagnostics as queries over a log with a run, an order and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.elementary import poisoned
from stratapanel.operators.quantiles import exact_quantiles


def loss_spikes(log: DataFrame, run: str, order: str, loss: str, width: int = 100, factor: float = 5.0, least: int = 10) -> DataFrame:
    """Adds rolling_mean of the up to ``width`` finite losses before, and is_spike beyond ``factor`` times it.

    Rows without a finite loss are left out and don't enter the mean; a spike needs at
    least ``least`` losses before.
    """
    clean = log.where(~poisoned(F.col(loss)))
    before = Window.partitionBy(run).orderBy(order).rowsBetween(-width, -1)
    out = clean.withColumn("rolling_mean", F.avg(loss).over(before)).withColumn("seen", F.count(loss).over(before))
    return out.withColumn("is_spike", (F.col("seen") >= least) & (F.col(loss) > factor * F.col("rolling_mean")))


def loss_stability(log: DataFrame, by: list[str], loss: str, warn_cv: float = 0.5) -> DataFrame:
    """Mean, population deviation, bounds and coefficient of variation of each epoch's losses."""
    found = log.groupBy(*by).agg(F.avg(loss).alias("mean"), F.stddev_pop(loss).alias("std"), F.min(loss).alias("low"), F.max(loss).alias("high"))
    found = found.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.abs(F.when(F.col("mean") != 0, F.col("mean")))).otherwise(0.0))
    return found.withColumn("unstable", F.col("cv") > warn_cv)


def runs_of(log: DataFrame, run: str, order: str, flag: str) -> DataFrame:
    """Adds run_length: how many rows up to this one have had the flag without a break (0 without it)."""
    rows = Window.partitionBy(run).orderBy(order)
    islands = log.withColumn("_island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(rows))
    return islands.withColumn("run_length", F.sum(F.col(flag).cast("int")).over(Window.partitionBy(run, "_island").orderBy(order))).drop("_island")


def patience(log: DataFrame, run: str, order: str, flag: str, limit: int) -> DataFrame:
    """The first row of each run at which the flag has held ``limit`` times in a row."""
    return runs_of(log, run, order, flag).where(F.col("run_length") >= limit).groupBy(run).agg(F.min(order).alias("stopped_at"))


def epoch_timing(log: DataFrame, run: str, epoch: str, seconds: str, epochs: int) -> DataFrame:
    """Adds mean_seconds so far and the estimated seconds that remain."""
    so_far = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    done = F.count("*").over(so_far)
    return log.withColumn("mean_seconds", F.avg(seconds).over(so_far)).withColumn("remaining_seconds", (epochs - done) * F.col("mean_seconds"))


def human_duration(seconds) -> F.Column:
    """45s, 3m 5s or 2h 10m."""
    s = F.floor(seconds)
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s"))).otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor((s % 3600) / 60), F.lit("m")))


def layer_norms(values: DataFrame, layer: str, value: str) -> DataFrame:
    """L2 norm of each layer, and its null or NaN, infinite and zero entries."""
    v = F.col(value).cast("double")
    lost = v.isNull() | F.isnan(v)
    return values.groupBy(layer).agg(F.sqrt(F.sum(v * v)).alias("norm"), F.count_if(lost).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("inf"), F.count_if(v == 0).alias("zero"), F.count("*").alias("n"))


def norm_summary(norms: DataFrame, low: float = 1e-7, high: float = 500.0) -> DataFrame:
    """Least, greatest, mean and median norm over layers, and how many vanish or explode."""
    n = F.col("norm")
    median = exact_quantiles(norms, {"norm": n}, [0.5])["norm"]
    return norms.agg(F.min(n).alias("low"), F.max(n).alias("high"), F.avg(n).alias("mean"), F.lit(median[0] if median else None).cast("double").alias("median"), F.count_if(n < low).alias("vanishing"), F.count_if(n > high).alias("exploding"), F.sum("nan").alias("nan"), F.sum("inf").alias("inf"))


def offenders(norms: DataFrame, layer: str, high: float, n: int = 3) -> DataFrame:
    """The first ``n`` layers, by norm, beyond a bound."""
    return norms.where(F.col("norm") > high).orderBy(F.desc("norm"), layer).limit(n)


def last_of_epoch(log: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value of each epoch's last batch."""
    return log.groupBy(*by).agg(F.max_by(value, order).alias("value"), F.max(order).alias(order))


def timeline_stats(panel: DataFrame, entity: str, value: str) -> DataFrame:
    """Of each timeline: mean, population deviation, bounds, zeros and their share, mean of the rest (0 if none)."""
    v = F.col(value)
    zero = (v == 0).cast("double")
    return panel.groupBy(entity).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v == 0).alias("zeros"), F.avg(zero).alias("zero_share"), F.coalesce(F.avg(F.when(v != 0, v)), F.lit(0.0)).alias("mean_nonzero"))


def describe(stats: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: count, mean, deviation, bounds and exact quartiles."""
    quartiles = exact_quantiles(stats, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        v = F.col(c).cast("double")
        q = [F.lit(x).cast("double") for x in quartiles[c] or [None] * 3]
        rows.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(v).alias("high")))
    return stats.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def sampled_entities(panel: DataFrame, entity: str, n: int, seed: int) -> DataFrame:
    """``n`` entities drawn by a digest of seed and name, the same in every run."""
    drawn = panel.select(entity).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string"))), entity).limit(n)
    return panel.join(drawn, entity, "left_semi")
