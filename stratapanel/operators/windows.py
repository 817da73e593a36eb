"""Input windows of rolling origins, and training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.operators.panel import between
from stratapanel.spec import PanelSpec, Partition


def origins_of_rows(panel: DataFrame, spec: PanelSpec, test_start: int, input_length: int, sequences: int) -> DataFrame:
    """The rows that serve as input, once for each origin, with sequence_number and step (0 is the oldest).

    Sequence n reads [test_start + n - input_length, test_start + n - 1].  The origins
    that a row serves are a short range, so it is exploded; no range join is needed.
    """
    t = F.col(spec.time)
    low = F.greatest(t - test_start + 1, F.lit(0))
    high = F.least(t - test_start + input_length, F.lit(sequences - 1))
    rows = between(panel, spec, test_start - input_length, test_start + sequences - 2)
    served = rows.withColumn("sequence_number", F.explode(F.when(low <= high, F.sequence(low, high))))
    return served.withColumn("step", t - (F.lit(test_start - input_length) + F.col("sequence_number")))


def _vector(features: Sequence[str]) -> Column:
    """The features of one row as an array; nulls count as 0."""
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))


def origin_windows(panel: DataFrame, spec: PanelSpec, column: str, test_start: int, input_length: int, sequences: int, features: Sequence[str] = ()) -> DataFrame:
    """One row for each entity and origin with a full window: the values in time order.

    With ``features``, ``past`` holds them for all steps of the inputs, step after step.
    """
    rows = origins_of_rows(panel, spec, test_start, input_length, sequences)
    cells = [F.col(column).alias("y"), *([_vector(features).alias("x")] if features else [])]
    windows = rows.groupBy(spec.entity, "sequence_number").agg(F.array_sort(F.collect_list(F.struct("step", *cells))).alias("w"))
    past = [F.flatten("w.x").alias("past")] if features else []
    return windows.where(F.size("w") == input_length).select(spec.entity, "sequence_number", (F.lit(test_start) + F.col("sequence_number")).alias("origin"), F.col("w.y").alias("inputs"), *past)


def training_windows(panel: DataFrame, spec: PanelSpec, column: str, input_length: int, output_length: int, shift: int = 0, time_range: tuple[int, int] | None = None, features: Sequence[str] = ()) -> DataFrame:
    """Every run of consecutive times with room for inputs and outputs: (entity, start, inputs, outputs).

    ``shift`` steps lie between inputs and outputs.  With ``features``, ``past`` holds them
    for the steps of the inputs alone, step after step, so that no later value is read.
    """
    if time_range is not None:
        panel = between(panel, spec, *time_range)
    length = input_length + shift + output_length
    ahead = Window.partitionBy(spec.entity).orderBy(spec.time).rowsBetween(0, length - 1)
    inputs = Window.partitionBy(spec.entity).orderBy(spec.time).rowsBetween(0, input_length - 1)
    past = [F.flatten(F.collect_list(_vector(features)).over(inputs)).alias("past")] if features else []
    rows = panel.select(spec.entity, F.col(spec.time).alias("start"), F.collect_list(F.col(column)).over(ahead).alias("w"), F.max(spec.time).over(ahead).alias("last"), *past)
    full = rows.where((F.size("w") == length) & (F.col("last") == F.col("start") + (length - 1)))
    return full.select(spec.entity, "start", F.slice("w", 1, input_length).alias("inputs"), F.slice("w", input_length + shift + 1, output_length).alias("outputs"), *(["past"] if features else []))


#: Entities whose static covariates are sent to all tasks.
STATIC_ROWS = 100_000


def with_static(windows: DataFrame, spec: PanelSpec, static: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``static``: the entity's columns, 0 where it has none.

    ``static`` has a row for each entity, and is sent to all tasks if a count shows that
    it is small; else both sides are shuffled.
    """
    rows = static.select(spec.entity, _vector(columns).alias("static"))
    if static.count() <= STATIC_ROWS:
        rows = F.broadcast(rows)
    return windows.join(rows, spec.entity, "left").withColumn("static", F.coalesce("static", F.array(*(F.lit(0.0) for _ in columns))))


def forecast_grid(entities: DataFrame, spec: PanelSpec, first: int, steps: int, sequences: int = 1) -> DataFrame:
    """(entity, sequence_number, step, time) for the steps 1..n of each origin."""
    cells = entities.select(spec.entity).distinct()
    cells = cells.withColumn("sequence_number", F.explode(F.sequence(F.lit(0), F.lit(sequences - 1))))
    cells = cells.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return cells.withColumn(spec.time, F.lit(first) + F.col("sequence_number") + F.col("step") - 1)


def partition_rows(panel: DataFrame, spec: PanelSpec, partition: Partition, input_length: int, output_length: int) -> DataFrame:
    """Rows with their part: train, validation (with inputs), or both."""
    fit, (start, end), _ = partition.validation(input_length, output_length)
    t = F.col(spec.time)
    return panel.withColumn("in_train", t.between(*fit.train)).withColumn("in_validation", t.between(start, end)).where("in_train or in_validation")
