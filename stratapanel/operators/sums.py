"""Sums of large arrays over all tasks: Gram matrices and gradients.

Each task adds up its own rows, so that few arrays are shuffled; these meet by key and
salt first and by key then, so that no task gets an array from every other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
SCHEMA = "k int, v binary"


def _adder() -> Callable:
    """A closure, which travels to executors by value."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist()):
                x = np.frombuffer(v)
                held[k] = held[k] + x if k in held else x
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["k", "v"])

    return add


def tree_sum(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sum for each key of ``rows`` (k int, v binary of doubles); keys and lengths are the caller's to bound."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("k", "salt").select("k", "v").mapInArrow(_adder(), SCHEMA)
    whole = salted.repartition("k").mapInArrow(_adder(), SCHEMA)
    return {r["k"]: np.frombuffer(bytes(r["v"])) for r in whole.collect()}
