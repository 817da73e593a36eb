"""Scores of predictions against actuals.

``scored`` joins the two on their keys once; all metrics are aggregates of its cells,
overall or by month, step or sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.operators.quantiles import exact_quantiles, in_bins


def scored(predictions: DataFrame, actuals: DataFrame, keys: list[str], prediction: str, actual: str) -> DataFrame:
    """Inner join of predictions with actuals on the panel keys, as columns p and y."""
    return predictions.withColumnRenamed(prediction, "p").join(actuals.select(*keys, F.col(actual).alias("y")), keys)


def _raw(c: str) -> Column:
    return F.greatest(F.col(c).cast("double"), F.lit(0.0))


def point_metrics() -> dict[str, Column]:
    """Aggregates over cells p and y in raw space; both are held at 0 or above."""
    p, y = _raw("p"), _raw("y")
    log_error = F.log1p(p) - F.log1p(y)
    spread = F.stddev_pop(p) * F.stddev_pop(y)  # no correlation with a constant
    return {
        "n": F.count("*"),
        "mse": F.avg((p - y) * (p - y)),
        "msle": F.avg(log_error * log_error),
        "rmsle": F.sqrt(F.avg(log_error * log_error)),
        "mae": F.avg(F.abs(p - y)),
        "pearson": F.when(spread > 1e-9, F.covar_pop(p, y) / F.when(spread > 1e-9, spread)),
        "ratio": F.coalesce(F.avg(F.when(y > 0, p / F.when(y > 0, y))), F.lit(1.0)),
    }


def metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Point metrics overall, or by columns."""
    return cells.groupBy(*(by or [])).agg(*(m.alias(n) for n, m in point_metrics().items()))


def metrics_by_each(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Metrics by each of several columns in one pass over the cells: (dimension, value, metrics)."""
    tagged = cells.select("p", "y", F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("long").alias("value")) for d in dimensions))))
    return metrics(tagged, ["dimension", "value"])


def mean_ratio(cells: DataFrame) -> DataFrame:
    """Mean of predictions over truths where the truth is positive; 1 if none is."""
    return cells.agg(point_metrics()["ratio"].alias("ratio"))


def calibration(cells: DataFrame, threshold: float, series: list[str] | None = None) -> DataFrame:
    """Means, lower median, ratio of means, bias and deviations; event and peace series apart.

    A series is an event series if it goes beyond the threshold at any time.  The
    ratio is null where the mean truth vanishes.
    """
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    median = exact_quantiles(cells, {"p": p}, [0.5], discrete=True)["p"]
    if series:
        cells = cells.withColumn("is_event", F.max(F.abs("y")).over(Window.partitionBy(*series)) > threshold)
    else:
        cells = cells.withColumn("is_event", F.abs("y") > threshold)
    return cells.agg(
        F.count("*").alias("n"),
        F.avg(p).alias("mean_p"),
        F.avg(y).alias("mean_y"),
        F.lit(median[0] if median else None).cast("double").alias("median_p"),
        F.when(F.avg(y) > 1e-6, F.avg(p) / F.when(F.avg(y) > 1e-6, F.avg(y))).alias("ratio"),
        F.avg(p - y).alias("bias"),
        F.stddev_samp(p).alias("std_p"),
        F.stddev_samp(y).alias("std_y"),
        F.avg(F.when(F.col("is_event"), p)).alias("event_mean_p"),
        F.avg(F.when(F.col("is_event"), y)).alias("event_mean_y"),
        F.avg(F.when(~F.col("is_event"), p)).alias("peace_mean_p"),
        F.count_if("is_event").alias("event_cells"),
    )


def average_precision(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Area under precision over recall of y > threshold ranked by p; equal scores are one rank.

    Scores are summed up first, so the ranking has a row for each distinct score; the
    running counts are those of the bins above plus counts within a bin.  Null scores
    rank last.
    """
    scores = cells.groupBy(F.lit(0).alias("c"), F.col("p").cast("double").alias("x")).agg(F.count("*").alias("n"), F.count_if(F.col("y") > threshold).alias("hits"))
    binned = in_bins(scores)
    totals = binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    offsets = totals.select("bin", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("h0"))
    within = Window.partitionBy("bin").orderBy(F.desc("x"))
    run = binned.join(F.broadcast(offsets), "bin").withColumn("seen", F.col("n0") + F.sum("n").over(within)).withColumn("found", F.col("h0") + F.sum("hits").over(within))
    return run.agg((F.sum(F.col("hits") * F.col("found") / F.col("seen")) / F.sum("hits")).alias("average_precision"))


def earth_mover(cells: DataFrame, bins: list[float]) -> DataFrame:
    """Mean distance of the distributions of p and y over bins (one row; bins are few)."""
    names = []
    for v in ("p", "y"):
        names += [F.avg((F.col(v) <= b).cast("double")).alias(f"{v}{i}") for i, b in enumerate(bins)]
    widths = np.diff(bins).tolist()
    found = cells.agg(*names)
    distance = sum((F.abs(F.col(f"p{i}") - F.col(f"y{i}")) * w for i, w in enumerate(widths)), F.lit(0.0))
    return found.select(distance.alias("earth_mover"))


def _sorted(samples: Column) -> Column:
    return F.array_sort(F.transform(samples, lambda x: x.cast("double")))


def crps(samples: Column, y: Column) -> Column:
    """mean |x - y| - 1/2 mean |x - x'| over all pairs, by the sorted form in one pass."""
    s, n = _sorted(samples), F.size(samples)
    near = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / n
    weighted = F.zip_with(s, F.sequence(F.lit(1), n), lambda x, i: x * (2 * i - n - 1))
    return near - F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / (n * n)


def quantile(samples: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array."""
    s = _sorted(samples)
    at = F.lit(float(q)) * (F.size(samples) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(samples) - 1)
    return F.get(s, low) + (F.get(s, high) - F.get(s, low)) * (at - low)


def sample_metrics(cells: DataFrame, samples: str, alpha: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Mean CRPS, coverage and mean interval score of the central 1 - alpha interval, ignorance (normal)."""
    x, y = F.col(samples), F.col("y").cast("double")
    low, high = quantile(x, alpha / 2), quantile(x, 1 - alpha / 2)
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / n
    rows = cells.select(*(by or []), y.alias("y"), x.alias("x"), low.alias("low"), high.alias("high"), mean.alias("mean"))
    spread = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v.cast("double") - F.col("mean")) * (v.cast("double") - F.col("mean"))) / F.size("x"))
    rows = rows.withColumn("spread", F.greatest(spread, F.lit(1e-6)))
    below, above = F.greatest(F.col("low") - F.col("y"), F.lit(0.0)), F.greatest(F.col("y") - F.col("high"), F.lit(0.0))
    z = (F.col("y") - F.col("mean")) / F.col("spread")
    return rows.groupBy(*(by or [])).agg(
        F.avg(crps(F.col("x"), F.col("y"))).alias("crps"),
        F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"),
        F.avg(F.col("high") - F.col("low") + 2 / alpha * (below + above)).alias("mis"),
        F.avg((F.log(F.col("spread")) + 0.5 * z * z + 0.9189385332046727) / 0.6931471805599453).alias("ignorance"),
    )


def prediction_sanity(cells: DataFrame, band: float = 1e-3) -> DataFrame:
    """Spread of predictions, the share near their mean, and whether they have collapsed."""
    moments = cells.agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"), F.min("p").alias("low"), F.max("p").alias("high"))
    near = cells.crossJoin(F.broadcast(moments)).groupBy("mean", "std", "low", "high").agg(F.avg((F.abs(F.col("p") - F.col("mean")) < band).cast("double")).alias("near_mean"))
    return near.withColumn("collapsed", (F.col("std") < 1e-4) & (F.col("near_mean") > 0.95))
