"""Globally fitted scalers, chains of them, and routing of columns to them.

A scaler is fitted on all entities' rows at once.  Its parameters are a few numbers
for each column, so transforms and inverses are plain column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions.normal import normal_cdf, normal_quantile, once
from stratapanel.functions.transforms import ELEMENTWISE, yeo_johnson, yeo_johnson_inverse
from stratapanel.operators.quantiles import exact_quantiles

FITTED = ("StandardScaler", "RobustScaler", "MinMaxScaler", "MaxAbsScaler", "YeoJohnson", "QuantileUniform", "QuantileNormal")
NAMES = (*ELEMENTWISE, *FITTED)
#: Quantiles of the quantile scalers, and the least share that a normal score stands for.
QUANTILES, LEAST_SHARE = 1000, 1e-7


@dataclass(frozen=True)
class Step:
    name: str
    kwargs: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"unknown scaler {self.name!r}; known are {', '.join(NAMES)}")


def is_chain(spec) -> bool:
    return isinstance(spec, str) and "->" in spec


def parse_chain(spec) -> list[Step]:
    """Steps of "A", "A->B", ["A", "B"], {"chain": [...]} or {"name": ..., "kwargs": {...}}."""
    if isinstance(spec, str):
        names = [s.strip() for s in spec.split("->")]
        if not all(names):
            raise ValueError(f"empty step in {spec!r}")
        return [Step(n) for n in names]
    if isinstance(spec, list | tuple):
        if not spec:
            raise ValueError("an empty chain")
        return [s for part in spec for s in parse_chain(part)]
    if isinstance(spec, dict):
        if "chain" in spec:
            return parse_chain(spec["chain"])
        if "name" in spec:
            return [Step(spec["name"], dict(spec.get("kwargs") or {}))]
        raise ValueError(f"neither a chain nor a name in {spec!r}")
    raise TypeError(f"{spec!r} names no scaler")


@dataclass(frozen=True)
class Fit:
    """A fitted step for one column: affine ones as (x - center) / scale."""

    name: str
    center: float = 0.0
    scale: float = 1.0
    power: float | None = None
    quantiles: tuple[float, ...] = ()

    def forward(self, x: Column) -> Column:
        if self.name in ELEMENTWISE:
            return ELEMENTWISE[self.name][0](x)
        if self.quantiles:
            return _interpolated(self, True)(x.cast("double"))
        if self.power is not None:
            x = yeo_johnson(x, self.power)
        return (x - self.center) / self.scale

    def inverse(self, z: Column) -> Column:
        if self.name in ELEMENTWISE:
            return ELEMENTWISE[self.name][1](z)
        if self.quantiles:
            return _interpolated(self, False)(z.cast("double"))
        x = z * self.scale + self.center
        return x if self.power is None else yeo_johnson_inverse(x, self.power)


def _places(x: Column, grid: Column, n: int, at_most: bool) -> Column:
    """How many of the n sorted values are below x (or at most x), by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)))
    taken = (lambda v: v <= x) if at_most else (lambda v: v < x)
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(taken(F.get(grid, low + s - 1)), low + s).otherwise(low))


def _interpolated(fit: Fit, forward: bool) -> Callable[[Column], Column]:
    """Empirical distribution function of a quantile fit, or its inverse, as a column expression.

    A value that some quantiles equal lies between the first and the last of their ranks.
    """
    n, normal = len(fit.quantiles), fit.name == "QuantileNormal"
    grid = F.split(F.lit(",".join(map(repr, fit.quantiles))), ",").cast("array<double>")  # folded to one constant

    def rank(x: Column, below: Column, upto: Column) -> Column:
        left, right = F.get(grid, upto - 1), F.get(grid, upto)
        between = upto - 1 + (x - left) / (right - left)
        return F.when(upto > below, (below + upto - 1) / 2).when(upto == 0, 0.0).when(upto == n, float(n - 1)).otherwise(between) / (n - 1)

    def up(x: Column) -> Column:
        p = once(_places(x, grid, n, False), lambda below: once(_places(x, grid, n, True), lambda upto: rank(x, below, upto)))
        if normal:
            p = normal_quantile(F.greatest(F.least(p, F.lit(1 - LEAST_SHARE)), F.lit(LEAST_SHARE)))
        return F.when(x.isNull() | F.isnan(x), x).otherwise(p)

    def between(p: Column, left: Column) -> Column:
        a, b = F.get(grid, left), F.get(grid, left + 1)
        return a + (b - a) * (p - left)

    def down(z: Column) -> Column:
        edge = 1.1 * LEAST_SHARE if normal else 0.0
        share = once(normal_cdf(z) if normal else z, lambda p: F.when(p <= edge, 0.0).when(p >= 1 - edge, 1.0).otherwise(p) * (n - 1))
        x = once(share, lambda p: once(F.least(F.floor(p), F.lit(n - 2)).cast("int"), lambda left: between(p, left)))
        return F.when(z.isNull() | F.isnan(z), z).otherwise(x)

    return (lambda x: once(x, up)) if forward else (lambda z: once(z, down))


def _fit_step(df: DataFrame, values: dict[str, Column], step: Step) -> dict[str, Fit]:
    """Fits one step on all columns in one job (a few for quantiles, and for a power, whose likelihood is searched)."""
    name, kw = step.name, step.kwargs
    if name in ELEMENTWISE:
        return {c: Fit(name) for c in values}
    if name == "YeoJohnson":
        return _fit_power(df, values)
    low, high = kw.get("feature_range", (0.0, 1.0))
    q_low, q_high = kw.get("quantile_range", (25.0, 75.0))
    if name in ("RobustScaler", "QuantileUniform", "QuantileNormal"):
        n = kw.get("n_quantiles", QUANTILES)
        found = exact_quantiles(df, values, [0.5, q_low / 100, q_high / 100] if name == "RobustScaler" else [i / (n - 1) for i in range(n)])
    else:
        makes = {
            "StandardScaler": lambda v: [F.avg(v), F.stddev_pop(v)],
            "MinMaxScaler": lambda v: [F.min(v), F.max(v)],
            "MaxAbsScaler": lambda v: [F.max(F.abs(v))],
        }
        found = df.agg(*(F.array(*makes[name](v.cast("double"))).alias(c) for c, v in values.items())).first()
    out = {}
    for c in values:
        if found[c] is None or found[c][0] is None:
            raise ValueError(f"{c} has no values to fit on")
        got = [float(x) for x in found[c]]
        if name == "StandardScaler":
            out[c] = Fit(name, got[0], got[1] or 1.0)
        elif name == "RobustScaler":
            out[c] = Fit(name, got[0], (got[2] - got[1]) or 1.0)
        elif name == "MinMaxScaler":
            scale = ((got[1] - got[0]) or 1.0) / (high - low)
            out[c] = Fit(name, got[0] - low * scale, scale)
        elif name == "MaxAbsScaler":
            out[c] = Fit(name, 0.0, got[0] or 1.0)
        else:
            out[c] = Fit(name, quantiles=tuple(got))
    return out


def _fit_power(df: DataFrame, values: dict[str, Column], rounds: int = 4, points: int = 17) -> dict[str, Fit]:
    """Power by maximum likelihood: each round scores a grid for all columns in one job and narrows it."""
    ranges = {c: (-3.0, 5.0) for c in values}
    for _ in range(rounds):
        grids = {c: np.linspace(*ranges[c], points).tolist() for c in values}
        scores = []
        for c, v in values.items():
            x = v.cast("double")
            jacobian = F.sum(F.signum(x) * F.log1p(F.abs(x)))
            spread = lambda lam: F.log(F.greatest(F.var_pop(yeo_johnson(x, lam)), F.lit(1e-300)))  # noqa: B023, E731
            scores.append(F.array(*((lam - 1) * jacobian - F.count(x) / 2 * spread(lam) for lam in grids[c])).alias(c))
        found = df.agg(*scores).first()
        for c in values:
            score = [float("-inf") if s is None or s != s else s for s in found[c]]
            best = int(np.argmax(score))
            ranges[c] = (grids[c][max(best - 1, 0)], grids[c][min(best + 1, points - 1)])
    powers = {c: sum(ranges[c]) / 2 for c in values}
    moments = df.agg(*(F.array(F.avg(yeo_johnson(v.cast("double"), powers[c])), F.stddev_pop(yeo_johnson(v.cast("double"), powers[c]))).alias(c) for c, v in values.items())).first()
    return {c: Fit("YeoJohnson", moments[c][0], moments[c][1] or 1.0, powers[c]) for c in values}


class Scaler:
    """One scaler or chain for some columns: ``fit`` reads rows, the rest are expressions."""

    def __init__(self, spec, columns: list[str]):
        self.spec, self.steps, self.columns = spec, parse_chain(spec), list(columns)
        self.fits: dict[str, list[Fit]] | None = None

    def fit(self, df: DataFrame) -> Scaler:
        values = {c: F.col(c).cast("double") for c in self.columns}
        fits: dict[str, list[Fit]] = {c: [] for c in self.columns}
        for step in self.steps:  # each on the output of the ones before
            for c, f in _fit_step(df, values, step).items():
                fits[c].append(f)
                values[c] = f.forward(values[c])
        self.fits = fits
        return self

    def _fitted(self) -> dict[str, list[Fit]]:
        if self.fits is None:
            raise RuntimeError("the scaler isn't fitted")
        return self.fits

    def forward(self, column: str, x: Column) -> Column:
        for f in self._fitted()[column]:
            x = f.forward(x)
        return x

    def backward(self, column: str, z: Column) -> Column:
        for f in reversed(self._fitted()[column]):
            z = f.inverse(z)
        return z

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.forward(c, F.col(c).cast("double")) for c in self.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.backward(c, F.col(c).cast("double")) for c in self.columns})

    def inverse_samples(self, df: DataFrame, column: str, samples: str) -> DataFrame:
        """Inverts each sample of an array."""
        return df.withColumn(samples, F.transform(samples, lambda z: self.backward(column, z.cast("double"))))

    def parameters(self) -> dict:
        return {c: [f.__dict__ for f in fits] for c, fits in self._fitted().items()}


class GroupedScaler:
    """Routes columns to scalers; columns of no group get the default, if their names are given.

    ``groups`` is {spec: [columns]} or {name: {"scaler": spec, "features": [columns]}}.
    """

    def __init__(self, groups: dict, default="RobustScaler", all_columns: list[str] | None = None):
        routes: list[tuple[object, list[str]]] = []
        named = bool(groups) and isinstance(next(iter(groups.values())), dict)
        for key, value in groups.items():
            spec, columns = (value.get("scaler"), value.get("features", [])) if named else (key, value)
            if spec is None:
                raise ValueError(f"group {key!r} has no scaler")
            routes.append((spec, list(columns)))
        seen = [c for _, columns in routes for c in columns]
        if len(seen) != len(set(seen)):
            raise ValueError("a column is in two groups")
        rest = [c for c in all_columns or [] if c not in seen]
        if rest:
            routes.append((default, rest))
        self.groups, self.default = groups, default
        self.scalers = [Scaler(spec, columns) for spec, columns in routes if columns]

    def mapping(self) -> dict[str, str]:
        return {c: "->".join(step.name for step in s.steps) for s in self.scalers for c in s.columns}

    @property
    def is_fitted(self) -> bool:
        return all(s.fits is not None for s in self.scalers)

    def fit(self, df: DataFrame) -> GroupedScaler:
        for s in self.scalers:
            s.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.scalers:
            df = s.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for s in self.scalers:
            df = s.inverse_transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def _fits_of(parameters: dict) -> dict[str, list[Fit]]:
    return {c: [Fit(**(f | {"quantiles": tuple(f["quantiles"])})) for f in fits] for c, fits in parameters.items()}


def scaler_state(scaler: Scaler | GroupedScaler) -> dict:
    """What JSON can hold of a fitted scaler, or of a group of them with its routing."""
    if isinstance(scaler, Scaler):
        return {"spec": scaler.spec, "columns": scaler.columns, "parameters": scaler.parameters()}
    return {"spec": scaler.groups, "default": scaler.default, "members": [scaler_state(s) for s in scaler.scalers]}


def scaler_from_state(state: dict) -> Scaler | GroupedScaler:
    if "members" not in state:
        scaler = Scaler(state["spec"], state["columns"])
        scaler.fits = _fits_of(state["parameters"])
        return scaler
    grouped = GroupedScaler(state["spec"], state["default"])
    grouped.scalers = [scaler_from_state(s) for s in state["members"]]
    return grouped


def save_scaler(spark: SparkSession, scaler: Scaler | GroupedScaler, spec, path: str) -> None:
    """Writes specification and parameters to a one-row table, on any file system that Spark writes to."""
    row = json.dumps(scaler_state(scaler) | {"spec": spec})
    spark.createDataFrame([(row,)], "artifact string").coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, expected_spec=None) -> Scaler | GroupedScaler:
    """Reads a saved scaler; raises if it was fitted with another specification than expected."""
    saved = json.loads(spark.read.parquet(path).first()["artifact"])
    if expected_spec is not None and saved["spec"] != json.loads(json.dumps(expected_spec)):
        raise ValueError(f"the saved scaler is {saved['spec']!r}, the configured one {expected_spec!r}")
    return scaler_from_state(saved)
