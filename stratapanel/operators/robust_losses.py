"""Losses that need more than a mean of cells: reweighting by the whole batch, level and spectrum.

The input has a series column, a step column (0, 1, ...), predictions and truths; all
rows are one batch.  Moments of the batch are one-row aggregates that are sent to all
tasks, so no step gathers the batch in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import cos, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.elementary import asinh, log_cosh, repaired, silu
from stratapanel.operators.scans import leaking_peak, moving_average, scan, spread

# Frame length and hop of each spectral resolution.
RESOLUTIONS = ((6, 3), (12, 6), (24, 12))


def barron(x: Column) -> Column:
    return (F.pow(2 * x * x + 1, F.lit(0.75)) - 1) / 3


def log_cosh_cubic(x: Column) -> Column:
    a = F.abs(x)
    return log_cosh(x) * (1 + F.log1p(a * a * a))


def asinh_integral(x: Column) -> Column:
    return x * asinh(x) - F.hypot(x, F.lit(1.0)) + 1


def root_one(x: Column) -> Column:
    return F.sqrt(x * x + 1) - 1


def power_law(x: Column) -> Column:
    return F.pow(x * x + 1e-6, F.lit(0.75)) - 1e-6**0.75


@dataclass(frozen=True)
class Family:
    """How one of the reweighted losses is put together.

    weight: factor of a cell from (error, truth, prediction, threshold).  level: None,
    or the function of mean errors; parts: over how many windows of a series, none for
    the whole series.  gated: spectrum times a gate instead of delta.
    """

    cell: Callable[[Column, Column], Column]
    weight: Callable[[Column, Column, Column, float], Column]
    centred: bool = True
    level: Callable[[Column], Column] | None = None
    parts: tuple[int, int] | None = None  # (least width, divisor of the length)
    spread_to_blend: bool = False  # blend by the deviation itself, not by its share of the mean
    floor_spread: bool = True  # a vanishing deviation counts as 0.1
    gated: bool = False


def _beyond(y: Column, p: Column, tau: float) -> Column:
    return F.greatest(F.abs(y), F.abs(p)) > tau


def _difficulty_by_ratio(e: Column, y: Column, p: Column, tau: float) -> Column:
    return 1 + F.when(_beyond(y, p, tau), F.abs(e) / (1 + F.abs(e))).otherwise(0.0)


def _difficulty_by_size(e: Column, y: Column, p: Column, tau: float) -> Column:
    top = F.greatest(F.abs(y), F.abs(p))
    return 1 + 4 * (1 - F.exp(-F.abs(e))) * (top / (tau + top))


FAMILIES = {
    "PrismLoss": Family(lambda e, event: 0.5 * e * e, lambda e, y, p, t: 1 + (1 - F.exp(-F.abs(e))) * (1 - F.exp(-F.greatest(F.abs(y), F.abs(p)))), centred=False, spread_to_blend=True, floor_spread=False),
    "SpotlightLoss": Family(lambda e, event: barron(e), lambda e, y, p, t: 1 + (1 - F.exp(-F.abs(e))) * (1 - F.exp(-F.abs(y))), level=barron, floor_spread=False),
    "SpotlightLossLogcosh": Family(lambda e, event: log_cosh_cubic(e), _difficulty_by_size, level=log_cosh_cubic, parts=(6, 3), gated=True),
    "SpotlightLossAsinh": Family(lambda e, event: asinh_integral(e), _difficulty_by_size, level=asinh_integral, parts=(6, 3), gated=True),
    "SpotlightLossHuber": Family(lambda e, event: root_one(e), _difficulty_by_ratio, level=root_one, parts=(4, 6)),
    "SpotlightLossPowerLaw": Family(lambda e, event: F.when(event, power_law(e)).otherwise(log_cosh(e)), _difficulty_by_ratio, level=log_cosh, parts=(4, 6)),
}


def reweighted(df: DataFrame, loss: str, by: list[str] | None = None, spread_to_blend: bool = False, floor_spread: bool = True, name: str = "w") -> DataFrame:
    """Adds weights with mean about 1 that grow with the logarithm of a loss column.

    ``by`` None: moments of all rows, else of each group.  Deviations have n - 1
    degrees of freedom.
    """
    out = df.withColumn("_log", F.log(F.col(loss) + 1e-8))

    def moment(frame: DataFrame, aggregates: list[Column]) -> DataFrame:
        if by:
            return frame.join(frame.groupBy(*by).agg(*aggregates), by)
        return frame.crossJoin(F.broadcast(frame.agg(*aggregates)))  # one row

    out = moment(out, [F.avg("_log").alias("_mean"), F.stddev_samp("_log").alias("_std")])
    spread = F.col("_std")
    if floor_spread:
        spread = F.when(spread.isNull() | F.isnan(spread) | (spread < 1e-8), 0.1).otherwise(spread)
    out = out.withColumn("_std", spread)
    z = (F.col("_log") - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(0.1))
    out = out.withColumn("_raw", F.log1p(F.greatest(1 + z, F.lit(0.0))))
    out = moment(out, [F.greatest(F.avg("_raw"), F.lit(1e-8)).alias("_scale")])
    share = F.col("_std") if spread_to_blend else F.log1p(F.col("_std") / (F.abs("_mean") + 1e-8))
    blend = share / (share + 1)
    weight = blend * F.col("_raw") / F.col("_scale") + (1 - blend)
    return out.withColumn(name, repaired(weight)).drop("_log", "_mean", "_std", "_raw", "_scale")


def level_loss(df: DataFrame, series: str, step: str, error: str, steps: int, family: Family) -> DataFrame:
    """One row: T times the mean loss of mean errors, by window with reweighting, or by whole series."""
    if family.parts is None:
        means = df.groupBy(series).agg(F.avg(error).alias("m"))
        return means.agg((F.lit(float(steps)) * F.avg(family.level(F.col("m")))).alias("level"))
    width = max(family.parts[0], steps // family.parts[1])
    means = df.groupBy(series, F.floor(F.col(step) / width).alias("part")).agg(F.avg(error).alias("m")).withColumn("l", family.level(F.col("m")))
    return reweighted(means, "l").agg((F.lit(float(steps)) * F.avg(F.col("w") * F.col("l"))).alias("level"))


def _frame_tables(steps: int) -> list[tuple[int, list[tuple[int, int, int, float, float]]]]:
    """For each resolution (frame, step, bin, cosine, sine) with the periodic Hann window, for bins above 0."""
    out = []
    for n, hop in RESOLUTIONS:
        if steps < n:
            continue
        hann = [0.5 - 0.5 * cos(2 * pi * k / n) for k in range(n)]
        rows = [(f, start + k, b, hann[k] * cos(2 * pi * b * k / n), -hann[k] * sin(2 * pi * b * k / n)) for f, start in enumerate(range(0, steps - n + 1, hop)) for k in range(n) for b in range(1, n // 2 + 1)]
        out.append((n, rows))
    return out


def spectral_loss(df: DataFrame, series: str, step: str, prediction: str, truth: str, steps: int, threshold: float) -> DataFrame:
    """One row: mean over resolutions of the mean log_cosh of differences of spectral magnitudes.

    Only series with a value beyond the threshold count; the constant bin counts as
    zero difference, but is part of the mean.  Each spectrum is a sum over a table of
    at most a few thousand coefficients, which is broadcast.
    """
    spark = df.sparkSession
    active = F.max(F.greatest(F.abs(truth), F.abs(prediction))).over(Window.partitionBy(series)) > threshold
    rows = df.select(F.col(series).alias("s"), F.col(step).alias("k"), F.col(prediction).alias("p"), F.col(truth).alias("y"), active.alias("on")).where("on")
    tables = _frame_tables(steps)
    if not tables:
        return spark.range(1).select(F.lit(0.0).alias("spectral"))
    means = []
    for n, table in tables:
        basis = F.broadcast(spark.createDataFrame(table, "f int, k int, b int, re double, im double"))
        sums = rows.join(basis, "k").groupBy("s", "f", "b").agg(*(F.sum(F.col(v) * F.col(part)).alias(f"{v}_{part}") for v in ("p", "y") for part in ("re", "im")))
        size = lambda v, eps: F.sqrt(F.col(f"{v}_re") ** 2 + F.col(f"{v}_im") ** 2 + eps)
        difference = log_cosh(size("p", 1e-8) - size("y", 0.0))
        bins = n // 2 + 1
        means.append(sums.agg((F.sum(difference) / (F.count("*") * (bins / (bins - 1)))).alias("m")))
    total = reduce(DataFrame.unionByName, means)
    return total.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("t")).select((F.col("t") / len(tables)).alias("spectral"))


def family_loss(df: DataFrame, name: str, series: str, step: str, prediction: str, truth: str, steps: int, non_zero_threshold: float, delta: float = 0.0, gate: float = 0.05) -> DataFrame:
    """One row: shape, level, spectral, total of a reweighted loss by its manifest name."""
    family = FAMILIES[name]
    p, y = F.col(prediction).cast("double"), F.col(truth).cast("double")
    rows = df.select(F.col(series).alias("s"), F.col(step).alias("k"), p.alias("p"), y.alias("y"), (p - y).alias("e"))
    centre = F.avg("e").over(Window.partitionBy("s")) if family.centred else F.lit(0.0)
    cells = rows.withColumn("shape_e", F.col("e") - centre)
    cells = cells.withColumn("l", family.cell(F.col("shape_e"), _beyond(F.col("y"), F.col("p"), non_zero_threshold)))
    cells = reweighted(cells, "l", spread_to_blend=family.spread_to_blend, floor_spread=family.floor_spread)
    cells = cells.withColumn("c", family.weight(F.col("shape_e"), F.col("y"), F.col("p"), non_zero_threshold) * F.col("w"))
    # mean(c / mean(c) * l) without another pass
    out = cells.agg(F.coalesce(F.avg(F.col("c") * F.col("l")) / F.when(F.avg("c") > 0, F.avg("c")), F.avg("l")).alias("shape"))
    level = level_loss(rows, "s", "k", "e", steps, family) if family.level else df.sparkSession.range(1).select(F.lit(0.0).alias("level"))
    factor = 0.5 * gate if family.gated else delta
    if factor > 0 and steps >= 6:
        spectral = spectral_loss(rows, "s", "k", "p", "y", steps, non_zero_threshold)
    else:
        spectral = df.sparkSession.range(1).select(F.lit(0.0).alias("spectral"))
    out = out.crossJoin(F.broadcast(level)).crossJoin(F.broadcast(spectral))  # one row each
    return out.withColumn("total", F.col("shape") + F.col("level") + factor * F.col("spectral"))


def focal_loss(df: DataFrame, series: str, step: str, prediction: str, truth: str, steps: int, gamma: float, delta: float, non_zero_threshold: float) -> DataFrame:
    """One row: main, spectral, total of the focal log_cosh loss."""
    e = F.col(prediction) - F.col(truth)
    main = df.agg(F.avg(F.pow(1 - F.exp(-F.abs(e)), F.lit(float(gamma))) * log_cosh(e)).alias("main"))
    if delta > 0 and steps >= 6:
        spectral = spectral_loss(df, series, step, prediction, truth, steps, non_zero_threshold)
    else:
        spectral = df.sparkSession.range(1).select(F.lit(0.0).alias("spectral"))
    return main.crossJoin(F.broadcast(spectral)).withColumn("total", F.col("main") + delta * F.col("spectral"))


def sentinel_base(e: Column, alpha: float, delta: float) -> Column:
    q = (e / delta) * (e / delta)
    if alpha < 0.01:
        return delta**2 * F.log1p(q)
    return delta**2 / alpha * (F.pow(1 + q, F.lit(alpha / 2)) - 1)


def sentinel_loss(df: DataFrame, series: str, step: str, prediction: str, truth: str, alpha: float, beta: float, kappa: float, delta: float, gamma: float) -> DataFrame:
    """One row: point, change, total.  Magnitude weights are normalised by their own mean."""
    order = Window.partitionBy(series).orderBy(step)
    p, y = F.col(prediction).cast("double"), F.col(truth).cast("double")
    e, y_before = p - y, F.lag(y).over(order)
    rows = df.select(e.alias("e"), y.alias("y"), (e - F.lag(e).over(order)).alias("de"), F.greatest(F.abs(y), F.abs(y_before)).alias("top"), y_before.isNotNull().alias("has"))
    e, y = F.col("e"), F.col("y")
    weight = F.pow(1 + F.abs(y), F.lit(float(kappa)))
    amplified = 1 + beta * (silu(e) + silu(-e)) * (F.abs(y) / (1 + F.abs(y))) if beta > 0 else F.lit(1.0)
    point = F.avg(weight * sentinel_base(e, alpha, delta) * amplified) / (F.avg(weight) + 1e-8)
    turn = F.when(F.col("has"), F.pow(1 + F.col("top"), F.lit(float(kappa))))
    change = gamma * F.avg(turn * sentinel_base(F.col("de"), alpha, delta)) / (F.avg(turn) + 1e-8) if gamma > 0 else F.lit(0.0)
    return rows.agg(point.alias("point"), F.coalesce(change, F.lit(0.0)).alias("change")).withColumn("total", F.col("point") + F.col("change"))


def gates(losses: DataFrame, order: str, loss: str, run: str, momentum: float = 0.05, leak: float = 0.999, partitions: int | None = None) -> DataFrame:
    """Adds ema, peak and gate after each batch of a run: two folds in batch order.

    The mean's step is an affine map and the peak's the larger of two lines; both compose,
    so a run of any length is folded over many partitions (``scans``).  A loss that is null
    or NaN leaves the mean as it was.
    """
    log = losses.select(F.col(run).alias("r"), F.col(order).cast("bigint").alias("o"), F.col(loss).cast("double").alias("l"))
    means = scan(spread(log, "r", "o", ["l"], partitions), moving_average(momentum), "l", "ema")
    folded = scan(means, leaking_peak(leak), "ema", "peak")
    gate = F.when(F.col("peak") < 1e-8, 0.05).otherwise(F.greatest(F.least(1 - F.col("ema") / (F.col("peak") + 1e-8), F.lit(1.0)), F.lit(0.05)))
    return folded.select(F.col("r").alias(run), F.col("o").alias(order), "ema", "peak", gate.alias("gate"))
