"""Sweeps of settings: hashed draws, the losses of many trials in one pass, expected improvement over finished ones.

A space names each setting with a ``Range`` or a tuple of choices.  Trials are rows, so
they can be joined with what they led to; rows to be scored stay in Spark, and only
trials, a few hundred at most, are on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions.elementary import poisoned
from stratapanel.functions.normal import normal_cdf, once

#: Finished trials that a surrogate is fitted to; beyond them the best half and a hashed half of the rest.
MOST_TRIALS = 400
#: Trials that one pass over the rows scores.
BLOCK = 64
SCALES, NOISES = (0.1, 0.2, 0.4, 0.8, 1.6, 3.2), (1e-6, 1e-4, 1e-2, 1e-1)


@dataclass(frozen=True)
class Range:
    """Values from low to high, even in themselves or in their logarithm."""

    low: float
    high: float
    logarithmic: bool = False

    def __post_init__(self):
        if not self.low < self.high or (self.logarithmic and self.low <= 0):
            raise ValueError(f"no range from {self.low} to {self.high}")


Space = dict[str, Range | Sequence]


def _share(seed: int, name: str, trial: Column) -> Column:
    """A number from 0 to below 1 by a digest of seed, name and trial."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), trial.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


def _setting(of: Range | Sequence, share: Column) -> Column:
    if isinstance(of, Range):
        return F.exp(log(of.low) + share * (log(of.high) - log(of.low))) if of.logarithmic else of.low + share * (of.high - of.low)
    return F.get(F.array(*(F.lit(v) for v in of)), F.floor(share * len(of)).cast("int"))


def _coordinates(space: Space) -> list[Column]:
    """A setting's place between 0 and 1; a choice has one coordinate for each value, which puts all values equally far apart."""
    out = []
    for name, of in space.items():
        if not isinstance(of, Range):
            out += [F.when(F.col(name) == F.lit(v), 0.5**0.5).otherwise(0.0) for v in of]
        elif of.logarithmic:
            out.append((F.log(F.col(name)) - log(of.low)) / (log(of.high) - log(of.low)))
        else:
            out.append((F.col(name).cast("double") - of.low) / (of.high - of.low))
    return out


def draws(spark: SparkSession, space: Space, n: int, seed: int, first: int = 0) -> DataFrame:
    """(trial, settings): trials ``first`` to ``first`` + n - 1, each the same in every run."""
    trials = spark.range(first, first + n).withColumnRenamed("id", "trial")
    return trials.select("trial", *(_setting(of, _share(seed, name, F.col("trial"))).alias(name) for name, of in space.items()))


def scored_trials(rows: DataFrame, trials: DataFrame, space: Space, loss: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """(trial, settings, loss): the mean over ``rows`` of a column made from a trial's settings.

    ``trials`` is a stated list, read to the driver; each pass over the rows scores up to
    BLOCK of them by one aggregate, combined before the shuffle.  A loss of no rows is null.
    """
    listed = trials.select("trial", *space).collect()
    if not listed:
        return trials.select("trial", *space).withColumn("loss", F.lit(None).cast("double"))
    out = None
    for i in range(0, len(listed), BLOCK):
        block = [[F.lit(t[c]).alias(c) for c in ("trial", *space)] + [F.avg(loss({c: F.lit(t[c]) for c in space})).cast("double").alias("loss")] for t in listed[i : i + BLOCK]]
        part = rows.agg(F.array(*(F.struct(*cells) for cells in block)).alias("_t")).select(F.inline("_t"))
        out = part if out is None else out.unionByName(part)
    return out


class Surrogate:
    """A Gaussian process with a Matérn kernel of order 5/2, scaled for each coordinate, on standardised losses.

    Scales and noise climb the marginal likelihood over short lists, one at a time, from
    equal scales on.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.centre, self.spread = float(y.mean()), float(y.std()) or 1.0
        fits = [((s,) * x.shape[1], n) for s in SCALES for n in NOISES]
        best = max(fits, key=lambda f: self._likelihood(*f))
        for _ in range(2):
            for d in range(x.shape[1]):
                best = max([((*best[0][:d], s, *best[0][d + 1 :]), best[1]) for s in SCALES], key=lambda f: self._likelihood(*f))
            best = max([(best[0], n) for n in NOISES], key=lambda f: self._likelihood(*f))
        self.scales, self.noise = np.array(best[0]), best[1]

    def _factor(self, scales, noise) -> np.ndarray:
        k = _kernel()(self.x, self.x, np.array(scales))
        return np.linalg.cholesky(k + (noise + 1e-9) * np.eye(len(k)))

    def _likelihood(self, scales, noise) -> float:
        lower = self._factor(scales, noise)
        z = np.linalg.solve(lower, (self.y - self.centre) / self.spread)
        return float(-0.5 * z @ z - np.log(np.diag(lower)).sum())

    def imagined(self, point: np.ndarray) -> Surrogate:
        """The same process, were the best loss so far found at ``point`` too: what keeps proposals of one round apart."""
        new = object.__new__(Surrogate)
        new.__dict__ = {**self.__dict__, "x": np.vstack((self.x, point)), "y": np.append(self.y, self.y.min())}
        return new

    def posterior(self):
        """A closure from points to means and deviations of the loss; it travels to executors by value."""
        kernel, x, scales, centre, spread = _kernel(), self.x, self.scales, self.centre, self.spread
        inverse = np.linalg.inv(self._factor(scales, self.noise))
        weights = inverse.T @ (inverse @ ((self.y - centre) / spread))

        def of(points):
            k = kernel(points, x, scales)
            deviation = np.sqrt(np.maximum(1 - ((k @ inverse.T) ** 2).sum(axis=1), 0))
            return centre + spread * (k @ weights), spread * deviation

        return of


def _kernel():
    def matern(a, b, scales):
        r = np.sqrt(5 * np.maximum((((a[:, None, :] - b[None, :, :]) / scales) ** 2).sum(axis=2), 0))
        return (1 + r + r * r / 3) * np.exp(-r)

    return matern


def expected_improvement(mean: Column, deviation: Column, best: float) -> Column:
    """How far below ``best`` a normal loss lies on average, counting 0 where it lies above."""
    gain = best - mean
    bell = lambda z: F.exp(-z * z / 2) / (2 * np.pi) ** 0.5
    uncertain = once(gain / deviation, lambda z: gain * normal_cdf(z) + deviation * bell(z))
    return F.when(deviation > 0, uncertain).otherwise(F.greatest(gain, F.lit(0.0)))


def _finished(trials: DataFrame, most: int) -> DataFrame:
    finite = trials.where(~poisoned(F.col("loss")))
    if finite.count() <= most:
        return finite
    best = finite.orderBy("loss", "trial").limit(most // 2)
    rest = finite.join(best.select("trial"), "trial", "left_anti").orderBy(F.md5(F.col("trial").cast("string")), "trial").limit(most - most // 2)
    return best.unionByName(rest)


def proposals(trials: DataFrame, space: Space, n: int, seed: int, candidates: int = 20_000, most: int = MOST_TRIALS) -> DataFrame:
    """(trial, settings, improvement): the next ``n`` trials by expected improvement over ``trials``, the most promising first.

    ``trials`` has trial, the settings and loss; trials whose loss is null or not finite
    are passed over, and of more than ``most`` the best half and a hashed half of the rest
    are used.  With fewer than two finished trials, settings are drawn and improvement is
    null.  ``candidates`` are drawn by a hash and scored in Spark; settings that have been
    tried aren't proposed again, so a small list of choices may give fewer than ``n``.
    """
    spark = trials.sparkSession
    last = trials.agg(F.max("trial")).first()[0]
    first = 0 if last is None else last + 1
    rows = _finished(trials, most).orderBy("trial").select("loss", *(c.alias(f"x{i}") for i, c in enumerate(_coordinates(space)))).collect()
    if len(rows) < 2:
        return draws(spark, space, n, seed, first).withColumn("improvement", F.lit(None).cast("double"))
    table = np.array([tuple(r) for r in rows], dtype=np.float64)
    model = Surrogate(table[:, 1:], table[:, 0])
    # other settings than those that a draw of the same seed gives
    pool = draws(spark, space, candidates, seed + 1_000_003 * (first + 1)).withColumn("_x", F.array(*_coordinates(space)))
    names, found, best = ["trial", *space], [], float(table[:, 0].min())
    for _ in range(n):
        of, known, width = model.posterior(), model.x, model.x.shape[1]

        def judged(batches):
            for batch in batches:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for i in range(0, len(x), 1024):
                    part = x[i : i + 1024]
                    new = (np.abs(part[:, None, :] - known[None, :, :]).max(axis=2) > 1e-9).all(axis=1)
                    mean, deviation = of(part)
                    columns = [pa.array(v) for v in (mean.round(9), deviation.round(9))]
                    rows = pa.RecordBatch.from_arrays([*batch.slice(i, len(part)).columns, *columns], [*batch.schema.names, "_m", "_d"])
                    yield rows.filter(pa.array(new))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields)
        scores = pool.mapInArrow(judged, f"{fields}, _m double, _d double")
        gain = F.round(expected_improvement(F.col("_m"), F.col("_d"), best), 12)
        top = scores.select(*names, "_x", gain.alias("improvement")).orderBy(F.desc("improvement"), "trial").limit(1).collect()
        if not top:
            break
        found.append(top[0])
        model = model.imagined(np.array(top[0]["_x"]))
    kinds = dict(pool.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", improvement double"
    return spark.createDataFrame([(first + i, *(r[c] for c in space), r["improvement"]) for i, r in enumerate(found)], schema)


def search(spark: SparkSession, space: Space, evaluate: Callable[[DataFrame], DataFrame], first: int, rounds: int, each: int, seed: int, candidates: int = 20_000) -> DataFrame:
    """(trial, round, settings, loss, best): ``first`` drawn trials, then ``rounds`` of ``each`` proposed ones.

    ``evaluate`` adds loss to (trial, settings), as ``scored_trials`` does.  ``best`` is the least
    loss up to a trial.  The same seed gives the same trials, however rows are dealt.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in draws(spark, space, 1, seed).dtypes) + ", loss double"
    asked, done, numbers = draws(spark, space, first, seed), [], {}
    for k in range(rounds + 1):
        new = evaluate(asked).select("trial", *space, F.col("loss").cast("double")).orderBy("trial").collect()
        numbers.update({r["trial"]: k for r in new})
        done += [tuple(r) for r in new]
        if k < rounds:
            asked = proposals(spark.createDataFrame(done, kinds), space, each, seed, candidates)
    out, best = [], None
    for row in done:
        loss = row[-1]
        if loss is not None and np.isfinite(loss):
            best = loss if best is None else min(best, loss)
        out.append((row[0], numbers[row[0]], *row[1:], best))
    head, _, tail = kinds.partition(", ")
    return spark.createDataFrame(out, f"{head}, round int, {tail}, best double")
