"""Incremental panels and stateful counters over event streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from stratapanel.functions.calendar import day_id


def daily_panel(events: DataFrame, time: str = "ts", entity: str = "user_id", value: str = "value", late: str = "1 day") -> DataFrame:
    """(day_id, entity, y, n) by event-time day; events later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    daily = timed.groupBy(F.window("_t", "1 day").alias("w"), entity).agg(F.sum(value).alias("y"), F.count("*").alias("n"))
    return daily.select(day_id(F.col("w.start")).alias("day_id"), entity, "y", "n")


def run_lengths(log: DataFrame, run: str, order: str, flag: str) -> DataFrame:
    """(run, last, run_length): how long the flag has held at the last row of each micro-batch.

    The state of a run is its current length and last position; rows of one micro-batch
    are put in order before they are folded.
    """

    def fold(key, batches, state: GroupState):
        length, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(order)
        for o, f in zip(rows[order], rows[flag]):
            length, last = (length + 1 if f else 0), int(o)
        state.update((length, last))
        yield pd.DataFrame({run: [key[0]], "last": [last], "run_length": [length]})

    kind = log.schema[run].dataType.simpleString()
    return log.groupBy(run).applyInPandasWithState(fold, f"{run} {kind}, last long, run_length long", "length long, last long", "update", GroupStateTimeout.NoTimeout)


def expiring_run_lengths(log: DataFrame, run: str, order: str, flag: str, time: str, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """(run, last, run_length, late_rows, closed): ``run_lengths`` whose state goes when a run falls silent.

    ``order`` is an integer place, ``time`` a timestamp.  Rows of one micro-batch are
    folded in order of place.  A row placed at or before the last one folded, or
    without a place, is counted in ``late_rows`` and not folded; one that is more than
    ``late`` behind the newest time is dropped by the watermark.  A null flag ends a
    run of flags.  When the watermark is ``idle`` past a run's newest time, a last
    row with ``closed`` is given and the state is dropped, so that rows after that
    start anew; a run without any time never closes.  A null run is a run of its own.

    Needs the RocksDB state store provider.
    """
    name, kind = run, log.schema[run].dataType.simpleString()
    names = [name, "last", "run_length", "late_rows", "closed"]
    if len({c.lower() for c in names}) < len(names):
        raise ValueError(f"run column is called like a result: {run}")
    silence = int(pd.Timedelta(idle).total_seconds() * 1000)
    # Plain names: rows reach the processor by name.
    timed = log.select(F.col(f"`{run}`").alias("run"), F.col(f"`{order}`").cast("long").alias("place"), F.coalesce(F.col(f"`{flag}`"), F.lit(False)).alias("flag"), F.col(f"`{time}`").cast("timestamp").alias("at"))
    timed = timed.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)

    class Fold(StatefulProcessor):  # within the function, so that it travels by value
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("run", "length long, last long, late long, timer long")

        def row(self, key, length, last, late_rows, closed):
            return pd.DataFrame({name: [key[0]], "last": pd.array([last], "Int64"), "run_length": [length], "late_rows": [late_rows], "closed": [closed]})

        def drop(self, timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.clear()

        def handleInputRows(self, key, rows, timerValues):
            passed = timerValues.getCurrentWatermarkInMs()
            length, last, late_rows, timer = self.state.get() if self.state.exists() else (0, None, 0, None)
            if timer is not None and timer <= passed:
                yield self.row(key, length, last, late_rows, True)
                self.drop(timer)
                length, last, late_rows, timer = 0, None, 0, None
            batch = pd.concat(list(rows)).sort_values("place", kind="stable")
            # Spark drops rows by the watermark of the micro-batch before; one that has just closed must not open again.
            batch = batch[batch["ms"].isna() | (batch["ms"] > passed) | (passed <= 0)]
            if batch.empty:
                return
            for place, held in zip(batch["place"], batch["flag"]):
                if pd.isna(place) or (last is not None and place <= last):
                    late_rows += 1
                else:
                    length, last = (length + 1 if held else 0), int(place)
            newest = batch["ms"].max()
            if not pd.isna(newest):
                due = int(newest) + silence
                if timer is None or due > timer:
                    if timer is not None:
                        self.handle.deleteTimer(timer)
                    self.handle.registerTimer(due)
                    timer = due
            self.state.update((length, last, late_rows, timer))
            yield self.row(key, length, last, late_rows, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                length, last, late_rows, _ = self.state.get()
                self.state.clear()
                yield self.row(key, length, last, late_rows, True)

        def close(self):
            pass

    schema = f"`{name}` {kind}, last long, run_length long, late_rows long, closed boolean"
    return timed.groupBy("run").transformWithStateInPandas(Fold(), schema, "update", "EventTime")
