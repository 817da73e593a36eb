"""Streams whose state expires."""

from __future__ import annotations

import os

import pytest

from stratapanel.streaming import panels

SCHEMA = "run string, k long, bad boolean, t timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def _play(spark, tmp_path, batches, name):
    """Rows that the stream gives when each batch is a micro-batch."""
    for i, rows in enumerate(batches):
        sql = " UNION ALL ".join(f"SELECT CAST({run} AS string) AS run, CAST({k} AS long) AS k, CAST({bad} AS boolean) AS bad, CAST({t} AS timestamp) AS t" for run, k, bad, t in rows)
        part = tmp_path / f"part{i}"
        spark.sql(sql).coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(file, (1_700_000_000 + 10 * i,) * 2)
        file.rename(tmp_path / "in" / f"{i}.parquet")
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = panels.expiring_run_lengths(log, "run", "k", "bad", "t")
    run = found.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=repr)


def test_late_and_idle_runs(rocks, tmp_path):
    day1, day3 = "'2024-01-01 {}'", "'2024-01-03 {}'"
    got = _play(
        rocks,
        tmp_path,
        [
            [("'a'", 1, "true", day1.format("10:01")), ("'a'", 0, "true", day1.format("10:00")), ("'b'", 0, "true", day1.format("10:00"))],
            [("'a'", 3, "true", day1.format("10:30")), ("'a'", 1, "true", day1.format("10:31")), ("'a'", "null", "true", day1.format("10:31"))],
            [("'c'", 0, "null", day3.format("13:00"))],
            [("'a'", 0, "true", day3.format("13:10")), ("'b'", 5, "true", day1.format("10:05"))],
        ],
        "late_and_idle",
    )
    assert got == sorted(
        [
            ("a", 1, 2, 0, False),
            ("b", 0, 1, 0, False),
            ("a", 3, 3, 2, False),  # a place that was passed and one without a place aren't folded
            ("c", 0, 0, 0, False),  # a null flag ends the run
            ("a", 3, 3, 2, True),  # silent for a day when its next row comes
            ("a", 0, 1, 0, False),  # so it starts anew
            ("b", 0, 1, 0, True),  # silent; its last row is behind the watermark
        ],
        key=repr,
    )


def test_nulls(rocks, tmp_path):
    got = _play(rocks, tmp_path, [[("null", 0, "true", "null")], [("null", 1, "true", "null"), ("'a'", "null", "true", "'2024-01-01 10:00'")]], "null_runs")
    assert got == sorted([(None, 0, 1, 0, False), (None, 1, 2, 0, False), ("a", None, 0, 1, False)], key=repr)


def test_clashing_name(rocks, tmp_path):
    log = rocks.readStream.schema("last string, k long, bad boolean, t timestamp").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        panels.expiring_run_lengths(log, "last", "k", "bad", "t")
