"""Audits of panels: queries that list offenders, and gates that raise."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapanel.errors import DataLeakageError, DataStarvationError, NumericalSanityError, TemporalHoleError
from stratapanel.functions.elementary import poisoned
from stratapanel.spec import PanelSpec

log = logging.getLogger(__name__)


def schema_faults(panel: DataFrame, spec: PanelSpec) -> list[str]:
    """What is wrong with the columns, without a job; 64-bit floats and unusual names only warn."""
    kinds = {f.name: f.dataType for f in panel.schema}
    faults = [f"no column {c}" for c in (*spec.keys, *spec.values) if c not in kinds]
    faults += [f"{c} isn't numeric" for c in spec.values if c in kinds and not isinstance(kinds[c], T.NumericType)]
    for c in spec.values:
        if isinstance(kinds.get(c), T.DoubleType):
            log.warning("%s has 64 bits; 32 are enough at the boundary", c)
    if spec.keys != ["month_id", "country_id"]:
        log.warning("unusual keys %s", spec.keys)
    return faults


def check_schema(panel: DataFrame, spec: PanelSpec) -> None:
    faults = schema_faults(panel, spec)
    if any(f.startswith("no column") for f in faults):
        raise KeyError("; ".join(faults))
    if faults:
        raise NumericalSanityError("; ".join(faults))


def numeric_audit(panel: DataFrame, columns: list[str], max_abs: float = 1e9) -> DataFrame:
    """One row for each column: rows, poisoned (null, NaN, infinite), outliers beyond ``max_abs``."""
    counts = []
    for c in columns:
        bad = poisoned(F.col(c))
        counts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(bad).alias("poisoned"), F.count_if(~bad & (F.abs(F.col(c)) > max_abs)).alias("outliers")))
    return panel.agg(F.array(*counts).alias("a")).select(F.inline("a"))


#: What is observed of a column in passing; moments leave null, NaN and infinite values out.
MOMENTS = ("n", "low", "mean", "high", "std", "nan", "inf")


def watched(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` with the moments of columns attached: the next job that reads it computes them on its way, without a scan of their own."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        held = F.when(~poisoned(x), x)
        cells += [F.struct(F.count("*"), F.min(held), F.avg(held), F.max(held), F.stddev_pop(held), F.count_if(x.isNull() | F.isnan(x)), F.count_if(F.abs(x) == float("inf"))).alias(c)]
    seen = Observation()
    return df.observe(seen, *cells), seen


def watched_inverse(df: DataFrame, scaler, columns: list[str]) -> tuple[DataFrame, dict[str, Observation]]:
    """The inverse transform, watched on both sides by the one job that writes it."""
    before, seen = watched(df, columns)
    after, seen_after = watched(scaler.inverse_transform(before), columns)
    return after, {"before": seen, "after": seen_after}


def moments(spark: SparkSession, seen: dict[str, Observation], columns: list[str]) -> DataFrame:
    """(side, column, n, low, mean, high, std, nan, inf) once a job has read what was watched; rows for any metrics sink."""
    rows = [(side, c, *o.get[c]) for side, o in seen.items() for c in columns]
    return spark.createDataFrame(rows, "side string, column string, n long, low double, mean double, high double, std double, nan long, inf long")


def check_numbers(panel: DataFrame, columns: list[str], max_abs: float = 1e9) -> None:
    for r in numeric_audit(panel, columns, max_abs).collect():  # a row for each column
        if r["poisoned"]:
            raise NumericalSanityError(f"{r['column']}: {r['poisoned']} of {r['rows']} values are null, NaN or infinite")
        if r["outliers"]:
            log.warning("%s: %d values beyond %g", r["column"], r["outliers"], max_abs)


def boundary_audit(panel: DataFrame, spec: PanelSpec, expected_end: int) -> DataFrame:
    """Each entity's last time id against the expected one: ok, leakage (later) or starvation (earlier)."""
    last = panel.groupBy(spec.entity).agg(F.max(spec.time).alias("last"))
    verdict = F.when(F.col("last") > expected_end, "leakage").when(F.col("last") < expected_end, "starvation").otherwise("ok")
    return last.withColumn("verdict", verdict)


def check_boundary(panel: DataFrame, spec: PanelSpec, expected_end: int) -> None:
    bad = boundary_audit(panel, spec, expected_end).where("verdict <> 'ok'").orderBy(spec.entity).first()
    if bad is not None:
        kind = DataLeakageError if bad["verdict"] == "leakage" else DataStarvationError
        raise kind(f"{spec.entity} {bad[0]} ends at {bad['last']}, not at {expected_end}")


def contiguity_audit(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Each entity's first and last time id, its distinct ids, and whether none is missing between."""
    t = F.col(spec.time)
    found = panel.groupBy(spec.entity).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count_distinct(t).alias("steps"))
    return found.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("steps"))


def holes(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """(entity, time): the ids missing between an entity's first and last."""
    spans = contiguity_audit(panel, spec).where(~F.col("contiguous"))
    expected = spans.select(spec.entity, F.explode(F.sequence("first", "last")).alias(spec.time))
    return expected.join(panel.select(*spec.keys), spec.keys, "left_anti")


def check_contiguity(panel: DataFrame, spec: PanelSpec) -> None:
    missing = holes(panel, spec).orderBy(*reversed(spec.keys)).limit(3).collect()
    if missing:
        raise TemporalHoleError("missing: " + ", ".join(f"{r[0]} at {r[1]}" for r in missing))


def shared_times(train: DataFrame, test: DataFrame, spec: PanelSpec) -> DataFrame:
    """Time ids that both have."""
    return train.select(spec.time).intersect(test.select(spec.time))


def check_leakage(train: DataFrame, test: DataFrame, spec: PanelSpec) -> None:
    both = shared_times(train, test, spec).orderBy(spec.time).limit(3).collect()
    if both:
        raise DataLeakageError(f"train and test share {[r[0] for r in both]}")


def check_ids(spark: SparkSession, ids: list[int]) -> None:
    """Raises if ids leave a hole."""
    spec = PanelSpec("time_id", "entity_id")
    check_contiguity(spark.createDataFrame([(i, 0) for i in ids], "time_id int, entity_id int"), spec)
