"""Registration of a query with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **renamed: str) -> DataFrame:
    """Floating columns rounded, so that two engines' last bits don't matter."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
