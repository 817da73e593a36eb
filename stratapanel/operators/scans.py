"""Folds in order over runs of any length, spread over range partitions.

Rows are dealt by ranges of (run, order), so a long run lies in many partitions.  Where
the steps of a fold compose to a small map, each partition first tells what its rows make
of an unknown state; these maps, one or two for each partition, give the state that each
partition starts from, and a second pass folds all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.sources.tables import shared_folder


@dataclass(frozen=True)
class Fold:
    """``step`` makes the next state of a state and a value; ``extend`` adds a value to a map of states, ``apply`` uses it."""

    start: float | None
    step: Callable[[float | None, float | None], float | None]
    identity: tuple
    extend: Callable[[tuple, float | None], tuple]
    apply: Callable[[tuple, float | None], float | None]


def moving_average(momentum: float) -> Fold:
    """Exponential mean; the first value starts it, and nulls leave it as it was.

    A map is (a, b, c): a state x becomes a x + b, and no state yet becomes c.
    """

    def step(x, v):
        return x if v is None else v if x is None else x + momentum * (v - x)

    def extend(f, v):
        a, b, c = f
        return f if v is None else ((1 - momentum) * a, b + momentum * (v - b), step(c, v))

    return Fold(None, step, (1.0, 0.0, None), extend, lambda f, x: f[2] if x is None else f[0] * x + f[1])


def leaking_peak(leak: float) -> Fold:
    """The largest value so far, where what is held shrinks by ``leak`` at each row; a map is (a, b): max(a x, b)."""

    def step(x, v):
        return x * leak if v is None else max(x * leak, v)

    def extend(f, v):
        a, b = f
        return (a * leak, b * leak if v is None else max(b * leak, v))

    return Fold(0.0, step, (1.0, float("-inf")), extend, lambda f, x: max(f[0] * x, f[1]))


def spread(log: DataFrame, run: str, order: str, values: list[str], partitions: int | None = None) -> DataFrame:
    """(r, o, values, pid): rows in order within range partitions, written to the checkpoint folder so that ranges stay as they are.

    Rows of one run that are alike in ``order`` share a partition; their order among
    themselves is by value.
    """
    spark = log.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    rows = log.select(F.col(run).alias("r"), F.col(order).alias("o"), *values)
    dealt = rows.repartitionByRange(partitions, "r", "o") if partitions else rows.repartitionByRange("r", "o")
    return dealt.sortWithinPartitions("r", "o", *values).withColumn("pid", F.spark_partition_id()).checkpoint()


def scan(rows: DataFrame, fold: Fold, value: str, out: str) -> DataFrame:
    """Adds ``out``, the state after each row of its run; ``rows`` come from ``spread``, sorted within partitions."""
    start, step, identity, extend, apply = fold.start, fold.step, fold.identity, fold.extend, fold.apply
    kind = rows.schema["r"].dataType.simpleString()
    names = rows.columns

    def survey(batches):
        """The first run of the partition with the map of its rows, and the last with its state if it starts here."""
        first = last = pid = None
        image, state, single, seen = identity, start, True, False
        for batch in batches:
            pid = batch.column("pid")[0].as_py() if batch.num_rows else pid
            for r, v in zip(batch.column("r").to_pylist(), batch.column(value).to_pylist()):
                v = None if v != v else v
                if not seen:
                    first, last, seen = r, r, True
                if r != last:
                    last, state, single = r, start, False
                if single:
                    image = extend(image, v)
                else:
                    state = step(state, v)
        if seen:
            cells = [pa.array([pid], pa.int32()), pa.array([first], batch.schema.field("r").type), pa.array([last], batch.schema.field("r").type), pa.array([list(image)], pa.list_(pa.float64())), pa.array([state], pa.float64()), pa.array([single])]
            yield pa.RecordBatch.from_arrays(cells, ["pid", "first", "last", "image", "state", "single"])

    found = rows.select("pid", "r", value).mapInArrow(survey, f"pid int, first {kind}, last {kind}, image array<double>, state double, single boolean")
    carried: dict[int, float | None] = {}
    run, state = None, start
    for p in sorted(found.collect(), key=lambda x: x["pid"]):  # a row for each partition
        state = state if p["first"] == run else start
        carried[p["pid"]] = state
        run, state = p["last"], apply(tuple(p["image"]), state) if p["single"] else p["state"]

    def fold_all(batches):
        last, state, seen = None, start, False
        for batch in batches:
            states = []
            for r, v in zip(batch.column("r").to_pylist(), batch.column(value).to_pylist()):
                v = None if v != v else v
                if not seen:
                    state, seen = carried[batch.column("pid")[0].as_py()], True
                elif r != last:
                    state = start
                last, state = r, step(state, v)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.float64())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(fold_all, f"{schema}, `{out}` double")
