"""Building, checking and cutting panels.

A panel is a DataFrame with a time id, an entity id and numeric columns; the pair of
ids is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.errors import NumericalSanityError
from stratapanel.functions import calendar
from stratapanel.spec import PanelSpec, Partition


def aggregate_panel(rows: DataFrame, time: Column, entity: Column, measures: dict[str, Column], spec: PanelSpec) -> DataFrame:
    """One row for each (time, entity) that occurs, with the aggregates in ``measures``."""
    return rows.groupBy(time.alias(spec.time), entity.alias(spec.entity)).agg(*(m.alias(n) for n, m in measures.items()))


def densify(panel: DataFrame, entities: DataFrame, spec: PanelSpec, fill: float = 0.0, span: tuple[int, int] | DataFrame | None = None) -> DataFrame:
    """All (time, entity) cells over ``span`` (default: all observed times), unobserved ones filled.

    A span is a pair of times, or a frame of one row with two columns, its first and last
    time, which is found within the plan and sent to all tasks.  Each entity gets its cells
    by exploding a sequence, so no times are collected; a span of nulls has no cells.
    """
    cells = entities.select(spec.entity).distinct()
    if span is None:
        span = panel.agg(F.min(spec.time), F.max(spec.time))
    if isinstance(span, DataFrame):
        times = span.toDF("first", "last").select(F.sequence("first", "last").alias(spec.time))
        cells = cells.crossJoin(F.broadcast(times))
    else:
        cells = cells.withColumn(spec.time, F.sequence(F.lit(span[0]), F.lit(span[1])))
    cells = cells.withColumn(spec.time, F.explode(spec.time))
    values = [c for c in panel.columns if c not in spec.keys]
    filled = [F.coalesce(F.col(c), F.lit(fill).cast(panel.schema[c].dataType)).alias(c) for c in values]
    return cells.join(panel, spec.keys, "left").select(*spec.keys, *filled)


def subset(panel: DataFrame, spec: PanelSpec, time_ids: int | list[int] | None = None, entity_ids: int | list[int] | None = None) -> DataFrame:
    """Rows of the given time and entity ids; None means all."""
    for column, ids in ((spec.time, time_ids), (spec.entity, entity_ids)):
        if ids is not None:
            panel = panel.where(F.col(column).isin(ids if isinstance(ids, list | tuple | range) else [ids]))
    return panel


def between(panel: DataFrame, spec: PanelSpec, start: int, end: int) -> DataFrame:
    """Rows of an inclusive time range; the predicate reaches the scan."""
    return panel.where(F.col(spec.time).between(start, end))


def airlock(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keys as integers, and those value columns that are there as 32-bit floats."""
    kept = [c for c in spec.values if c in panel.columns]
    keys = [F.col(c).cast("int") if dict(panel.dtypes)[c] not in ("int", "bigint", "string") else F.col(c) for c in spec.keys]
    return panel.select(*keys, *(F.col(c).cast("float").alias(c) for c in kept))


def long_enough(panel: DataFrame, spec: PanelSpec, partition: Partition, need: int) -> DataFrame:
    """Rows of the entities that have at least ``need`` rows in the training range."""
    start, end = partition.train
    counts = between(panel, spec, start, end).groupBy(spec.entity).count().where(F.col("count") >= need)
    return panel.join(counts.select(spec.entity), spec.entity, "left_semi")


def with_cyclic_encoders(panel: DataFrame, spec: PanelSpec, kind: str | None = None) -> DataFrame:
    """Adds sine and cosine columns for the panel's temporal resolution; leaves ``spec`` alone."""
    columns = calendar.cyclic(F.col(spec.time), kind or calendar.resolution(spec.time))
    return panel.withColumns({n: c.cast("float") for n, c in columns.items()})


def log_features(panel: DataFrame, columns: list[str], feature_scaler: str | None = None) -> DataFrame:
    """log1p of the non-negative part of the named columns; refused if the scaler takes logs too."""
    if columns and feature_scaler == "LogTransform":
        raise ValueError("log_features and LogTransform would take logs twice")
    return panel.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in columns if c in panel.columns})


def positions(panel: DataFrame, spec: PanelSpec, name: str = "position") -> DataFrame:
    """Adds 0, 1, ... in time order within each entity."""
    order = Window.partitionBy(spec.entity).orderBy(spec.time)
    return panel.withColumn(name, F.row_number().over(order) - 1)


def differences(panel: DataFrame, spec: PanelSpec, column: str) -> DataFrame:
    """Adds next value less this one; the last row of each entity is left out."""
    order = Window.partitionBy(spec.entity).orderBy(spec.time)
    return panel.withColumn("difference", F.lead(column).over(order) - F.col(column)).where(F.col("difference").isNotNull())


def split_by_position(panel: DataFrame, spec: PanelSpec, test_share: float = 0.2) -> DataFrame:
    """Adds is_train: whether a row is among the first int(n * (1 - test_share)) of its entity."""
    entity = Window.partitionBy(spec.entity)
    n = F.count("*").over(entity)
    return positions(panel, spec).withColumn("is_train", F.col("position") < F.floor(n * (1 - test_share))).drop("position")


def signal_entities(panel: DataFrame, spec: PanelSpec, columns: list[str], threshold: float) -> DataFrame:
    """Entities and whether any of the columns goes beyond the threshold at any time (event series)."""
    beyond = F.lit(False)
    for c in columns:
        beyond = beyond | (F.abs(c) > threshold)
    return panel.groupBy(spec.entity).agg(F.bool_or(beyond).alias("is_event"))


def as_arrays(panel: DataFrame, spec: PanelSpec, columns: list[str]) -> DataFrame:
    """One row for each entity: its first time id, and each column as an array in time order."""
    row = F.struct(spec.time, *columns)
    series = panel.groupBy(spec.entity).agg(F.array_sort(F.collect_list(row)).alias("s"))
    return series.select(spec.entity, F.col("s")[0][spec.time].alias("start"), *(F.col("s")[c].alias(c) for c in columns))


def require_unique_keys(panel: DataFrame, spec: PanelSpec) -> None:
    if not panel.groupBy(*spec.keys).count().where("count > 1").isEmpty():
        raise NumericalSanityError(f"{spec.keys} isn't unique")
