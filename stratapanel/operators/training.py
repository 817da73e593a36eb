"""Training of forecasting networks by gradients that Spark sums.

A step is one job: tasks compute the gradients of their windows under broadcast weights,
and ``sums.tree_sum`` adds them up in parts.  Only weights and a gradient, whose
size is the network's, are on the driver; windows never are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.operators.batches import epoch_batches
from stratapanel.operators.networks import SLOPES, BlockNetwork, Params, dropout
from stratapanel.operators.panel import between
from stratapanel.operators.sums import SCHEMA, tree_sum
from stratapanel.operators.windows import origin_windows, training_windows, with_static
from stratapanel.spec import OPTIMIZERS, PanelSpec

#: Values of a gradient that are summed together.
CHUNK = 1 << 16


@dataclass
class Optimizer:
    """Adam, AdamW, RAdam, SGD or RMSprop with their published defaults; ``step`` returns new weights."""

    name: str
    lr: float
    weight_decay: float = 0.0
    momentum: float = 0.0
    alpha: float = 0.99
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    steps: int = 0
    state: dict[str, Params] = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in OPTIMIZERS:
            raise ValueError(f"{self.name!r} is none of {', '.join(OPTIMIZERS)}")

    def _average(self, kind: str, k: str, x: np.ndarray, rate: float) -> np.ndarray:
        held = self.state.setdefault(kind, {})
        held[k] = rate * held.get(k, np.zeros_like(x)) + (1 - rate) * x
        return held[k]

    def _velocity(self, k: str, x: np.ndarray) -> np.ndarray:
        held = self.state.setdefault("velocity", {})
        held[k] = self.momentum * held.get(k, np.zeros_like(x)) + x
        return held[k]

    def step(self, params: Params, grads: Params) -> Params:
        self.steps += 1
        return {k: self._moved(k, p, grads[k]) for k, p in params.items()}

    def _moved(self, k: str, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.name == "AdamW":
            p = p * (1 - self.lr * self.weight_decay)
        else:
            g = g + self.weight_decay * p
        if self.name == "SGD":
            return p - self.lr * (self._velocity(k, g) if self.momentum else g)
        if self.name == "RMSprop":
            g = g / (np.sqrt(self._average("square", k, g * g, self.alpha)) + self.eps)
            return p - self.lr * (self._velocity(k, g) if self.momentum else g)
        b1, b2 = self.betas
        t = self.steps
        mean = self._average("mean", k, g, b1) / (1 - b1**t)
        root = np.sqrt(self._average("square", k, g * g, b2) / (1 - b2**t))
        if self.name != "RAdam":
            return p - self.lr * mean / (root + self.eps)
        longest = 2 / (1 - b2) - 1
        length = longest - 2 * t * b2**t / (1 - b2**t)
        if length <= 5:  # too short an average for its variance to be known
            return p - self.lr * mean
        rectified = math.sqrt((length - 4) * (length - 2) * longest / ((longest - 4) * (longest - 2) * length))
        return p - self.lr * mean * rectified / (root + self.eps / math.sqrt(1 - b2**t))


def clipped(grads: Params, norm: float | None) -> Params:
    """Gradients scaled so that their joint length is at most ``norm``."""
    length = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    return {k: g * (norm / length) for k, g in grads.items()} if norm and length > norm else grads


def stops_at(losses: Sequence[float], patience: int | None, min_delta: float = 0.0) -> int | None:
    """The position in a log of losses at which ``patience`` epochs have passed without a fall of more than ``min_delta``."""
    best, wait = math.inf, 0
    for i, x in enumerate(losses):
        best, wait = (x, 0) if x < best - min_delta else (best, wait + 1)
        if patience is not None and wait >= patience:
            return i
    return None


def _steps():
    """Closures over batches, which travel to executors by value."""

    def matrix(batch, name):
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)

    def more(batch, covariates):
        return np.hstack([np.zeros((batch.num_rows, 0)), *(matrix(batch, c) for c in covariates)])

    return matrix, more


class NetworkForecaster:
    """A network that is trained by gradients, with a log, early stopping, and samples by dropout.

    The loss is the mean over cells.  Epochs are one step over all windows, or one for each of
    the exact batches of ``batch_size`` windows (the rest of an epoch is left out), dealt anew
    each epoch.  ``weights`` are those with the lowest validation loss (``keep`` "best") or the
    last ones.
    """

    def __init__(self, network: BlockNetwork, loss: str, optimizer: Optimizer, loss_parameters: dict | None = None, epochs: int = 10, batch_size: int | None = None, patience: int | None = None, min_delta: float = 0.0, clip: float | None = None, keep: str = "best", seed: int = 0, features: Sequence[str] = (), static: Sequence[str] = ()):
        if loss not in SLOPES:
            raise ValueError(f"{loss!r} is none of {', '.join(SLOPES)}")
        if keep not in ("best", "last"):
            raise ValueError("keep is best or last")
        if (network.features, network.static) != (len(features), len(static)):
            raise ValueError("the network was made for other covariates")
        self.network, self.loss, self.loss_parameters, self.optimizer = network, loss, dict(loss_parameters or {}), optimizer
        self.epochs, self.batch_size, self.patience, self.min_delta = epochs, batch_size, patience, min_delta
        self.clip, self.keep, self.seed = clip, keep, seed
        self.features, self.static = tuple(features), tuple(static)
        self.weights: Params | None = None
        self.log: list[tuple[int, float, float | None, float, bool]] = []

    @property
    def _covariates(self) -> list[str]:
        return [*(["past"] if self.features else []), *(["static"] if self.static else [])]

    def windows(self, panel: DataFrame, spec: PanelSpec, column: str, time_range: tuple[int, int], static: DataFrame | None) -> DataFrame:
        rows = training_windows(panel, spec, column, self.network.input_length, self.network.output_length, time_range=time_range, features=self.features)
        rows = with_static(rows, spec, static, self.static) if self.static else rows
        return rows.withColumn("key", F.xxhash64(F.col(spec.entity).cast("string"), "start"))

    def gradient(self, windows: DataFrame, params: Params, salt: int) -> tuple[Params, float, float | None]:
        """Derivatives of the mean loss over the rows with ``trains``, that loss, and the loss over the others; one job."""
        network, slope, extra, covariates = self.network, SLOPES[self.loss], self.loss_parameters, self._covariates
        shapes, sent = network.shapes(), windows.sparkSession.sparkContext.broadcast(params)
        left = np.arange(network.output_length - 1, -1, -1)
        matrix, more = _steps()
        chunk = CHUNK

        def run(batches):
            held, grads, sums = sent.value, None, np.zeros(4)
            for batch in batches:
                trains = batch.column("trains").to_numpy(zero_copy_only=False)
                for part, rows in enumerate((batch.filter(pa.array(trains)), batch.filter(pa.array(~trains)))):
                    if not rows.num_rows:
                        continue
                    mask = dropout(rows.column("key").to_numpy(), salt, network.dropout) if network.dropout and part == 0 else None
                    y = matrix(rows, "outputs")
                    p, tape = network.forward(held, matrix(rows, "inputs"), more(rows, covariates), mask)
                    value, dy = slope(p, y, left, **extra)
                    sums[2 * part : 2 * part + 2] += value.sum(), value.size
                    if part == 0:
                        found = network.backward(held, tape, dy)
                        flat = np.concatenate([found[k].ravel() for k in shapes])
                        grads = flat if grads is None else grads + flat
            parts = [(-1, sums)] if sums[1] or sums[3] else []
            parts += [] if grads is None else [(i, grads[i * chunk : (i + 1) * chunk]) for i in range(-(-len(grads) // chunk))]
            for k, v in parts:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["k", "v"])

        summed = tree_sum(windows.select("inputs", "outputs", *covariates, "key", "trains").mapInArrow(run, SCHEMA))
        sent.unpersist()
        sums = summed.pop(-1, np.zeros(4))
        if not sums[1]:
            raise ValueError("no training window")
        flat = np.concatenate([summed[k] for k in sorted(summed)]) / sums[1]
        ends = np.cumsum([0, *(math.prod(s) for s in shapes.values())])
        grads = {k: flat[a:b].reshape(s) for (k, s), a, b in zip(shapes.items(), ends, ends[1:])}
        return grads, float(sums[0] / sums[1]), float(sums[2] / sums[3]) if sums[3] else None

    def fit(self, panel: DataFrame, spec: PanelSpec, column: str, train: tuple[int, int], validation: tuple[int, int] | None = None, static: DataFrame | None = None) -> NetworkForecaster:
        """Trains and logs (epoch, train_loss, val_loss, lr, is_best); losses are those of the weights that an epoch starts from.

        The validation range holds inputs and outputs.  Training stops when the validation
        loss (the training loss where there is none) hasn't fallen for ``patience`` epochs.
        """
        train_rows = self.windows(panel, spec, column, train, static).withColumn("trains", F.lit(True))
        rows = train_rows if validation is None else train_rows.unionByName(self.windows(panel, spec, column, validation, static).withColumn("trains", F.lit(False)))
        rows = rows.persist()
        params, best, watched = self.network.init(self.seed), None, []
        self.log = []
        try:
            for epoch in range(self.epochs):
                steps = [rows]
                if self.batch_size is not None:
                    dealt = epoch_batches(rows.where("trains"), ["key"], self.batch_size, epoch, self.seed)
                    n = dealt.agg(F.max("batch")).first()[0]
                    if n is None:
                        raise ValueError("fewer training windows than a batch")
                    dealt = dealt.persist()
                    steps = [dealt.where(F.col("batch") == b).drop("batch") for b in range(n + 1)]
                    steps[0] = steps[0].unionByName(rows.where("not trains"))
                start, losses = params, None
                for i, step in enumerate(steps):
                    grads, loss, val = self.gradient(step, params, self.seed * 1_000_003 + epoch * 1_009 + i)
                    losses = losses or (loss, val)
                    params = self.optimizer.step(params, clipped(grads, self.clip))
                if self.batch_size is not None:
                    dealt.unpersist()
                watched.append(losses[0] if losses[1] is None else losses[1])
                is_best = watched[-1] == min(watched) and watched.count(watched[-1]) == 1
                best = start if is_best else best
                self.log.append((epoch, *losses, self.optimizer.lr, is_best))
                if stops_at(watched, self.patience, self.min_delta) is not None:
                    break
        finally:
            rows.unpersist()
        self.weights = best if self.keep == "best" else params
        return self

    def log_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "epoch int, train_loss double, val_loss double, lr double, is_best boolean")

    def predict(self, panel: DataFrame, spec: PanelSpec, column: str, first: int, sequences: int = 1, num_samples: int = 1, mc_dropout: bool = False, seed: int = 0, static: DataFrame | None = None) -> DataFrame:
        """(time, entity, sequence_number, step, pred_{column} array): 32-bit samples, at least 0.

        With ``mc_dropout`` each sample drops units by a hash of entity, origin, sample and
        unit, so that repeated calls are equal whatever the partitioning; else all samples are
        the point forecast.
        """
        if self.weights is None:
            raise RuntimeError("the forecaster isn't fitted")
        network, covariates = self.network, self._covariates
        windows = origin_windows(panel, spec, column, first, network.input_length, sequences, self.features)
        windows = with_static(windows, spec, static, self.static) if self.static else windows
        sent = panel.sparkSession.sparkContext.broadcast(self.weights)
        kind, width = panel.schema[spec.entity].dataType.simpleString(), network.output_length
        matrix, more = _steps()

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, c, keys = matrix(batch, "inputs"), more(batch, covariates), batch.column("key").to_numpy()
                out = [network.forward(sent.value, x, c, dropout(keys, (seed << 20) + s, network.dropout) if mc_dropout else None)[0] for s in range(num_samples if mc_dropout else 1)]
                samples = np.maximum(np.stack(out, axis=2), 0).astype(np.float32)
                samples = np.repeat(samples, num_samples, axis=2) if samples.shape[2] < num_samples else samples
                take = pa.array(np.repeat(np.arange(batch.num_rows), width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, samples.size + 1, num_samples), pa.int32()), pa.array(samples.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("e").take(take), batch.column("sequence_number").take(take), batch.column("origin").take(take), pa.array(np.tile(np.arange(1, width + 1), batch.num_rows), pa.int32()), lists], ["e", "sequence_number", "origin", "step", "pred"])

        key = F.xxhash64(F.col(spec.entity).cast("string"), "sequence_number").alias("key")
        wide = windows.select(F.col(spec.entity).alias("e"), "sequence_number", "origin", "inputs", *covariates, key)
        out = wide.mapInArrow(run, f"e {kind}, sequence_number int, origin int, step int, pred array<float>")
        return out.select((F.col("origin") + F.col("step") - 1).alias(spec.time), F.col("e").alias(spec.entity), "sequence_number", "step", F.col("pred").alias(f"pred_{column}"))


def fitted_on(panel: DataFrame, spec: PanelSpec, time_range: tuple[int, int], columns: Sequence[str]) -> DataFrame:
    """(entity, columns): means of the columns over a time range, as static covariates."""
    return between(panel, spec, *time_range).groupBy(spec.entity).agg(*(F.avg(c).alias(c) for c in columns))
