"""Calendar ids and cyclic encoders.

Ids count from January 1980 (month 1) and from 1 January 1980 (day 1), a Tuesday.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1980-01-01"
# Cycles by temporal resolution, (prefix of the columns, steps of a cycle).
CYCLES = {
    "month": [("month", 12)],
    "week": [("week_of_year", 52)],
    "day": [("day_of_week", 7), ("day_of_year", 365)],
    "year": [],
}


def month_id(date: Column) -> Column:
    return ((F.year(date) - 1980) * 12 + F.month(date)).cast("int")


def day_id(date: Column) -> Column:
    return (F.datediff(F.to_date(date), F.to_date(F.lit(EPOCH))) + 1).cast("int")


def week_id(date: Column) -> Column:
    return (F.floor(F.datediff(F.to_date(date), F.to_date(F.lit(EPOCH))) / 7) + 1).cast("int")


def year_id(date: Column) -> Column:
    return F.year(date).cast("int")


def month_end(month: Column) -> Column:
    """The last day of the month with this id."""
    return F.last_day(F.add_months(F.to_date(F.lit(EPOCH)), month - 1))


def date_of_day(day: Column) -> Column:
    return F.date_add(F.to_date(F.lit(EPOCH)), day - 1)


def resolution(time_column: str) -> str:
    """The temporal resolution that a time column's first letter names."""
    found = {k[0]: k for k in CYCLES}.get(time_column[:1].lower())
    if found is None:
        raise ValueError(f"no temporal resolution in the name {time_column!r}")
    return found


def resolution_of_level(level: str) -> str:
    """The temporal resolution that a level's last letter names ("cm": country and month)."""
    return resolution(level[-1:])


def phase(time_id: Column, steps: int) -> Column:
    return 2 * pi * (F.pmod(time_id - 1, F.lit(steps)) / F.lit(float(steps)))


def cyclic(time_id: Column, kind: str) -> dict[str, Column]:
    """Sine and cosine columns by name for a resolution; none for years."""
    out = {}
    for prefix, steps in CYCLES[kind]:
        out[f"{prefix}_sin"] = F.sin(phase(time_id, steps))
        out[f"{prefix}_cos"] = F.cos(phase(time_id, steps))
    return out


def relative_position(time_id: Column, first: Column | int, last: Column | int) -> Column:
    """0 at the first step, 1 at the last."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.when(last > first, (time_id - first) / (last - first)).otherwise(0.0)
