"""Numerically careful elementary functions of columns."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def asinh(x: Column) -> Column:
    """Symmetric form: the built-in one loses all digits for large negatives."""
    return F.signum(x) * F.asinh(F.abs(x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """Never exponentiates a positive number."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def log_cosh(x: Column) -> Column:
    return F.abs(x) + softplus(-2 * F.abs(x)) - log(2.0)


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds ``x``; NaN stays NaN and null stays null, which ``greatest`` and ``least`` would hide."""
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(~F.isnan(x) & (x > high), F.lit(float(high))).otherwise(out)
    return F.when(F.isnan(x), x).otherwise(out)


def poisoned(x: Column) -> Column:
    """Whether a value is null, NaN or infinite."""
    x = x.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def repaired(w: Column) -> Column:
    """Weights with NaN and +inf as 1 and -inf as 0."""
    return F.when(w.isNull() | F.isnan(w) | (w == float("inf")), 1.0).when(w == float("-inf"), 0.0).otherwise(w)


def number_text(x: Column) -> Column:
    """A double as SQL engines write it: its fewest digits, plain from 0.0001 up to 1e16 and else as 1.5e+16.

    A cast to string turns to exponents at 10,000,000 already, and on Java 17 may have digits
    to spare; the first of 15 to 17 digits that gives the value back is taken.  From 1e16 on,
    the last of 17 digits may differ; subnormal numbers may have more than their fewest.
    """
    x = x.cast("double")
    forms = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    digits = F.coalesce(*(F.when(f.try_cast("double") == x, f) for f in forms), forms[-1])
    whole = lambda c: F.regexp_replace(c, r"\.$", ".0")
    plain = whole(F.rtrim(digits.try_cast("decimal(38,21)").cast("string"), F.lit("0")))
    exponent = F.concat(F.regexp_replace(F.substring_index(digits, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(digits, "e", -1))
    size = F.abs(x)
    text = F.when(x == 0, x.cast("string")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(odd, text))
