"""Elementwise transforms by name, each with its inverse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapanel.functions.elementary import asinh

Pair = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def _positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


ELEMENTWISE: dict[str, Pair] = {
    "AsinhTransform": (asinh, F.sinh),
    "LogTransform": (F.log1p, F.expm1),
    "SqrtTransform": (lambda x: F.sqrt(_positive(x)), lambda x: x * x),
    "FourthRootTransform": (lambda x: F.pow(1 + _positive(x), F.lit(0.25)) - 1, lambda x: F.pow(1 + _positive(x), F.lit(4.0)) - 1),
    "PassThrough": (lambda x: x, lambda x: x),
}


def log_target(y: Column) -> Column:
    """log1p of the non-negative part, as a 32-bit float."""
    return F.log1p(_positive(y)).cast("float")


def unlog_target(z: Column) -> Column:
    return F.expm1(_positive(z))


def yeo_johnson(x: Column, power: Column | float) -> Column:
    lam = power if isinstance(power, Column) else F.lit(float(power))
    up = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(lam == 0, 1.0).otherwise(lam))
    down = F.when(lam == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / F.when(lam == 2, 1.0).otherwise(2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(z: Column, power: float) -> Column:
    up = F.expm1(z) if power == 0 else F.pow(power * z + 1, F.lit(1 / power)) - 1
    down = 1 - F.exp(-z) if power == 2 else 1 - F.pow(1 - (2 - power) * z, F.lit(1 / (2 - power)))
    return F.when(z >= 0, up).otherwise(down)
