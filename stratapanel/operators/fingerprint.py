"""Per-entity statistics as static covariates.

All targets are aggregated in one pass; a slope over positions needs one sort of each
entity's rows.  Transforms are named as in "AsinhTransform->MaxAbsScaler": of the
elementwise ones and of those across entities the last of each kind holds, in this
order; the share of zeros is never transformed.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.functions.transforms import ELEMENTWISE
from stratapanel.operators.panel import between, positions
from stratapanel.operators.scaling import parse_chain
from stratapanel.spec import PanelSpec

log = logging.getLogger(__name__)
STATISTICS = ("mu", "sigma", "max", "trend", "sparsity")
ACROSS = ("MaxAbsScaler", "StandardScaler")


def fingerprints(panel: DataFrame, spec: PanelSpec, time_range: tuple[int, int] | None = None, transform: str | None = None) -> DataFrame:
    """(entity, {target}_{mu,sigma,max,trend,sparsity}) as 32-bit floats.

    sigma has n - 1 degrees of freedom and is 0 for a single row; the trend is the
    least-squares slope over positions, 0 where undefined.  ``time_range`` is inclusive.
    """
    if time_range is None:
        log.warning("statistics over all times may leak the test range")
        rows = panel
    else:
        rows = between(panel, spec, *time_range)
    rows = positions(rows, spec)
    aggregates = []
    for y in spec.targets:
        v = F.col(y).cast("double")
        aggregates += [
            F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{y}_mu"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{y}_sigma"),
            F.coalesce(F.max(v), F.lit(0.0)).alias(f"{y}_max"),
            F.coalesce(F.regr_slope(v, F.col("position").cast("double")), F.lit(0.0)).alias(f"{y}_trend"),
            F.avg((v == 0).cast("double")).alias(f"{y}_sparsity"),
        ]
    stats = rows.groupBy(spec.entity).agg(*aggregates)
    scaled = [f"{y}_{s}" for y in spec.targets for s in STATISTICS[:-1]]
    if transform:
        stats = _transformed(stats, scaled, transform)
    return stats.select(spec.entity, *(F.col(f"{y}_{s}").cast("float").alias(f"{y}_{s}") for y in spec.targets for s in STATISTICS))


def _transformed(stats: DataFrame, columns: list[str], transform: str) -> DataFrame:
    elementwise = across = None
    for step in parse_chain(transform):
        if step.name in ACROSS:
            across = step.name
        elif step.name in ("AsinhTransform", "LogTransform", "SqrtTransform", "FourthRootTransform"):
            elementwise = ELEMENTWISE[step.name][0]
        else:
            raise ValueError(f"static covariates can't be transformed by {step.name}")
    if elementwise:
        stats = stats.withColumns({c: elementwise(F.col(c)) for c in columns})
    if across:
        # One row of moments over the entities, sent to all of them.
        moments = stats.agg(*(m for c in columns for m in (F.max(F.abs(c)).alias(f"{c}__top"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"))))
        stats = stats.crossJoin(F.broadcast(moments))
        if across == "MaxAbsScaler":
            stats = stats.withColumns({c: F.when(F.col(f"{c}__top") > 0, F.col(c) / F.col(f"{c}__top")).otherwise(F.col(c)) for c in columns})
        else:
            stats = stats.withColumns({c: F.when(F.col(f"{c}__std") > 0, (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).otherwise(F.col(c)) for c in columns})
    return stats


def with_fingerprints(panel: DataFrame, stats: DataFrame, spec: PanelSpec) -> DataFrame:
    """The panel with its entities' statistics; Spark broadcasts them if they are small."""
    return panel.join(stats, spec.entity, "left")
