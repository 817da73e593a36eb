"""Forecasters whose fit is an aggregate.

Baselines are column expressions.  Linear forecasters map an input window to all output
steps; their normal equations are summed in Spark (a bounded matrix) and solved on
the driver.  Other architectures are known by name and have no backend here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.errors import NumericalSanityError
from stratapanel.functions.elementary import poisoned
from stratapanel.operators.panel import between
from stratapanel.operators.sums import SCHEMA, tree_sum
from stratapanel.operators.windows import forecast_grid, origin_windows, training_windows, with_static
from stratapanel.spec import ALGORITHMS, RUNNABLE, PanelSpec, Partition


def log_mean_baseline(panel: DataFrame, spec: PanelSpec, column: str, train: tuple[int, int] | None = None) -> DataFrame:
    """(entity, prediction): expm1 of the mean log1p of the training rows, at least 0."""
    rows = panel if train is None else between(panel, spec, *train)
    return rows.groupBy(spec.entity).agg(F.greatest(F.expm1(F.avg(F.log1p(F.col(column)))), F.lit(0.0)).alias("prediction"))


def baseline_forecast(panel: DataFrame, spec: PanelSpec, column: str, partition: Partition, steps: int, sequences: int = 1) -> DataFrame:
    """The baseline of each entity at every step of every origin."""
    fitted = log_mean_baseline(panel, spec, column, partition.train)
    return forecast_grid(fitted, spec, partition.train[1] + 1, steps, sequences).join(fitted, spec.entity)


def seasonal_naive(panel: DataFrame, spec: PanelSpec, column: str, partition: Partition, season: int, steps: int, sequences: int = 1) -> DataFrame:
    """Each step repeats the value one season (or as many as needed) before; nothing after the origin is read."""
    grid = forecast_grid(panel, spec, partition.train[1] + 1, steps, sequences)
    back = F.ceil(F.col("step") / season).cast("int") * season
    past = panel.select(spec.entity, F.col(spec.time).alias("_source"), F.col(column).alias("prediction"))
    return grid.withColumn("_source", F.col(spec.time) - back).join(past, [spec.entity, "_source"]).drop("_source")


def last_value(panel: DataFrame, spec: PanelSpec, column: str, partition: Partition, steps: int) -> DataFrame:
    rows = between(panel, spec, *partition.train)
    last = rows.groupBy(spec.entity).agg(F.max_by(column, spec.time).alias("prediction"))
    return forecast_grid(last, spec, partition.train[1] + 1, steps).join(last, spec.entity)


def lagged(panel: DataFrame, spec: PanelSpec, column: str, lag: int, name: str = "prediction") -> DataFrame:
    """Adds the value ``lag`` rows before; rows without one are left out."""
    order = Window.partitionBy(spec.entity).orderBy(spec.time)
    return panel.withColumn(name, F.lag(column, lag).over(order)).where(F.col(name).isNotNull())


#: Regressors and outputs of a design, and the side of a block of their products.
MOST_COLUMNS, BLOCK = 4_096, 256


def _design(from_last: bool, kernel_size: int):
    """A closure, which travels to executors by value: they need no copy of this package."""

    def design(x, *more):
        ones = np.ones((len(x), 1))
        if from_last:
            last = x[:, -1:]
            return np.hstack((x - last, *more, ones)), last
        padded = np.hstack((np.repeat(x[:, :1], (kernel_size - 1) // 2, axis=1), x, np.repeat(x[:, -1:], kernel_size // 2, axis=1)))
        trend = np.lib.stride_tricks.sliding_window_view(padded, kernel_size, axis=1).mean(axis=2)
        return np.hstack((trend, x - trend, *more, ones)), np.zeros((len(x), 1))

    return design


def _matrix():
    """A closure that reads a column of arrays of one length as a matrix."""

    def matrix(batch, name):
        lists = batch.column(name).combine_chunks() if isinstance(batch.column(name), pa.ChunkedArray) else batch.column(name)
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)

    return matrix


class LinearForecaster:
    """Ridge regression from windows of inputs to all output steps, shared by all entities.

    NLinearModel subtracts the last input and adds it back; DLinearModel maps a moving
    average and the remainder apart.  ``features`` of the steps of the inputs and
    ``static`` columns of the entity are further regressors.  Samples are point forecasts plus
    residuals drawn by a hash of entity, origin and number, so that they don't depend on
    partitioning.
    """

    def __init__(self, algorithm: str, input_length: int, output_length: int, ridge: float = 1.0, kernel_size: int = 5, features: Sequence[str] = (), static: Sequence[str] = ()):
        if algorithm not in ALGORITHMS:
            raise ValueError(f"{algorithm!r} is none of {', '.join(ALGORITHMS)}")
        if algorithm not in RUNNABLE:
            raise NotImplementedError(f"{algorithm} has no backend here; {', '.join(sorted(RUNNABLE))} have")
        self.algorithm, self.input_length, self.output_length = algorithm, input_length, output_length
        self.ridge, self.kernel_size = ridge, kernel_size
        self.features, self.static = tuple(features), tuple(static)
        self.weights: np.ndarray | None = None
        self.residuals: np.ndarray | None = None

    @property
    def design(self):
        """Function from rows of inputs (then covariates) to regressors and the offset that is added to all outputs."""
        return _design(self.algorithm == "NLinearModel", self.kernel_size)

    def _with_static(self, windows: DataFrame, spec: PanelSpec, static: DataFrame | None) -> DataFrame:
        if self.static and static is None:
            raise ValueError(f"static covariates are needed: {', '.join(self.static)}")
        return with_static(windows, spec, static, self.static) if self.static else windows

    @property
    def _covariates(self) -> list[str]:
        return [*(["past"] if self.features else []), *(["static"] if self.static else [])]

    def fit(self, panel: DataFrame, spec: PanelSpec, column: str, train: tuple[int, int], static: DataFrame | None = None) -> LinearForecaster:
        """Sums the products of all regressors and outputs in blocks and solves the normal equations on the driver.

        The matrix has at most MOST_COLUMNS columns, whatever the number of windows.
        """
        windows = training_windows(panel, spec, column, self.input_length, self.output_length, time_range=train, features=self.features)
        windows = self._with_static(windows, spec, static)
        design, matrix, width, covariates, block = self.design, _matrix(), self.output_length, self._covariates, BLOCK
        size = self.input_length * (1 if self.algorithm == "NLinearModel" else 2) + self.input_length * len(self.features) + len(self.static) + 1
        if size + width > MOST_COLUMNS:
            raise ValueError(f"{size} regressors and {width} outputs are more than {MOST_COLUMNS} columns")

        def gram(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    a, offset = design(matrix(batch, "inputs"), *(matrix(batch, c) for c in covariates))
                    both = np.hstack((a, matrix(batch, "outputs") - offset))
                    total = both.T @ both if total is None else total + both.T @ both
            parts = [] if total is None else range(-(-len(total) // block))
            for i in parts:
                for j in parts[i:]:
                    cells = total[i * block : (i + 1) * block, j * block : (j + 1) * block]
                    yield pa.RecordBatch.from_arrays([pa.array([i * len(parts) + j], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["k", "v"])

        summed = tree_sum(windows.select("inputs", "outputs", *covariates).mapInArrow(gram, SCHEMA))
        if not summed:
            raise ValueError("no training window")
        cuts = [*range(0, size + width, block), size + width]
        total = np.zeros((size + width, size + width))
        for k, v in summed.items():
            i, j = divmod(k, len(cuts) - 1)
            cells = v.reshape(cuts[i + 1] - cuts[i], -1)
            total[cuts[i] : cuts[i + 1], cuts[j] : cuts[j + 1]] = cells
            total[cuts[j] : cuts[j + 1], cuts[i] : cuts[i + 1]] = cells.T
        xtx, xty, yy = total[:size, :size], total[:size, size:], np.diag(total)[size:]
        self.weights = np.linalg.solve(xtx + self.ridge * np.eye(size), xty)
        explained = (2 * self.weights * xty).sum(axis=0) - np.einsum("ij,ik,kj->j", self.weights, xtx, self.weights)
        self.residuals = np.sqrt(np.maximum(yy - explained, 0) / xtx[-1, -1])  # the last regressor is 1: its square counts windows
        return self

    def predict(self, panel: DataFrame, spec: PanelSpec, column: str, first: int, sequences: int = 1, num_samples: int = 1, seed: int = 0, static: DataFrame | None = None) -> DataFrame:
        """(time, entity, sequence_number, step, pred_{column} array): 32-bit samples, at least 0."""
        if self.weights is None:
            raise RuntimeError("the forecaster isn't fitted")
        windows = self._with_static(origin_windows(panel, spec, column, first, self.input_length, sequences, self.features), spec, static)
        weights, spread, design, matrix, width, covariates = self.weights, self.residuals, self.design, _matrix(), self.output_length, self._covariates
        kind = panel.schema[spec.entity].dataType.simpleString()
        key = F.xxhash64(F.lit(seed), F.col(spec.entity).cast("string"), "sequence_number").alias("_key")

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, offset = design(matrix(batch, "inputs"), *(matrix(batch, c) for c in covariates))
                point = a @ weights + offset
                out = np.repeat(point[:, :, None], num_samples, axis=2)
                if num_samples > 1:
                    for r, k in enumerate(batch.column("_key").to_pylist()):
                        noise = np.random.default_rng(k & (2**63 - 1)).standard_normal((width, num_samples))
                        out[r] += noise * spread[:, None]
                out = np.maximum(out, 0).astype(np.float32)
                n = batch.num_rows
                take = pa.array(np.repeat(np.arange(n), width))
                step = np.tile(np.arange(1, width + 1), n)
                samples = pa.array(list(out.reshape(n * width, num_samples)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column("sequence_number").take(take), batch.column("origin").take(take), pa.array(step.astype(np.int32)), samples], ["e", "sequence_number", "origin", "step", "pred"])

        wide = windows.select(F.col(spec.entity).alias("e"), "sequence_number", "origin", "inputs", *covariates, key)
        out = wide.mapInArrow(run, f"e {kind}, sequence_number int, origin int, step int, pred array<float>")
        return out.select((F.col("origin") + F.col("step") - 1).alias(spec.time), F.col("e").alias(spec.entity), "sequence_number", "step", F.col("pred").alias(f"pred_{column}"))


def prediction_frame(points: DataFrame, spec: PanelSpec, targets: dict[str, Column]) -> DataFrame:
    """Point forecasts as the output contract has them: pred_{target} arrays of one 32-bit value, at least 0."""
    return points.select(*spec.keys, *(F.array(F.greatest(c, F.lit(0.0)).cast("float")).alias(f"pred_{t}") for t, c in targets.items()))


def check_predictions(frame: DataFrame, columns: list[str]) -> None:
    """Raises if any sample is null or no finite number."""
    bad = [F.count_if(F.exists(c, lambda x: poisoned(x))).alias(c) for c in columns]
    found = frame.agg(*bad).first()
    for c in columns:
        if found[c]:
            raise NumericalSanityError(f"{c}: {found[c]} predictions hold no finite number")
