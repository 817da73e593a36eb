import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import sweeps
from stratapanel.operators.sweeps import Range

SPACE = {"a": Range(0.0, 1.0), "b": Range(1e-4, 1.0, logarithmic=True), "kind": ("wide", "narrow")}


def surface(trials):
    """Least (0) at a = 0.3, b = 0.01 and narrow."""
    x, y = F.col("a") - 0.3, F.log10("b") + 2
    return trials.withColumn("loss", x * x * 10 + y * y + F.when(F.col("kind") == "wide", 0.5).otherwise(0.0))


def rows_of(df):
    return [tuple(r) for r in df.orderBy("trial").collect()]


def test_draws(spark):
    found = sweeps.draws(spark, SPACE, 2000, 1)
    rows = found.collect()
    assert all(0 <= r["a"] < 1 and 1e-4 <= r["b"] < 1 and r["kind"] in SPACE["kind"] for r in rows)
    assert abs(np.mean([r["a"] for r in rows]) - 0.5) < 0.03 and abs(np.mean([math.log10(r["b"]) for r in rows]) + 2) < 0.1
    assert rows_of(found) == rows_of(sweeps.draws(spark, SPACE, 1000, 1).unionByName(sweeps.draws(spark, SPACE, 1000, 1, first=1000)))
    assert rows_of(found) != rows_of(sweeps.draws(spark, SPACE, 2000, 2))
    for low, high, logarithmic in ((1, 1, False), (2, 1, False), (0, 1, True)):
        with pytest.raises(ValueError):
            Range(low, high, logarithmic)


def test_all_trials_in_one_pass_and_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "y double")
    trials = sweeps.draws(spark, {"a": Range(0.0, 3.0)}, 7, 3)
    loss = lambda s: F.abs(F.col("y") - s["a"])
    whole = rows_of(sweeps.scored_trials(rows, trials, {"a": Range(0.0, 3.0)}, loss))
    for _, a, v in whole:
        assert v == pytest.approx(np.mean([abs(y - a) for y in (1, 2, 4)]))
    monkeypatch.setattr(sweeps, "BLOCK", 3)
    assert rows_of(sweeps.scored_trials(rows, trials, {"a": 0}, loss)) == whole
    assert {r[2] for r in rows_of(sweeps.scored_trials(rows.limit(0), trials, {"a": 0}, loss))} == {None}
    assert sweeps.scored_trials(rows, trials.limit(0), {"a": 0}, loss).count() == 0


def test_improvement_is_the_mean_of_gains(spark):
    draws = np.random.default_rng(0).standard_normal(400_000)
    cells = spark.createDataFrame([(0.5, 1.0), (-1.0, 0.3), (3.0, 0.5), (0.2, 0.0), (2.0, 0.0)], "m double, d double")
    for m, d, ei in cells.select("m", "d", sweeps.expected_improvement(F.col("m"), F.col("d"), 1.0)).collect():
        assert ei == pytest.approx(np.maximum(1.0 - (m + d * draws), 0).mean(), abs=4e-3)


def test_surrogate_passes_through_what_it_saw():
    x = np.random.default_rng(1).random((30, 2))
    y = np.sin(5 * x[:, 0]) + x[:, 1]
    mean, deviation = sweeps.Surrogate(x, y).posterior()(x)
    assert np.abs(mean - y).max() < 0.01 and deviation.max() < 0.02
    new = np.random.default_rng(2).random((200, 2))
    mean, _ = sweeps.Surrogate(x, y).posterior()(new)
    assert np.abs(mean - np.sin(5 * new[:, 0]) - new[:, 1]).mean() < 0.1
    assert np.isfinite(sweeps.Surrogate(x, np.ones(30)).posterior()(new)[0]).all()


def test_search_beats_draws_and_repeats(spark):
    found, drawn = [], []
    for seed in (1, 2):
        log = sweeps.search(spark, SPACE, surface, 6, 5, 3, seed, candidates=4000).orderBy("trial").collect()
        assert [r["trial"] for r in log] == list(range(21)) and [r["round"] for r in log] == [0] * 6 + [k for k in range(1, 6) for _ in range(3)]
        assert [r["best"] for r in log] == list(np.minimum.accumulate([r["loss"] for r in log]))
        assert len({(r["a"], r["b"], r["kind"]) for r in log}) == 21
        found.append(log[-1]["best"])
        drawn.append(surface(sweeps.draws(spark, SPACE, 21, seed)).agg(F.min("loss")).first()[0])
    assert max(found) < min(drawn) and max(found) < 0.05
    spread = lambda t: surface(t.repartition(7))
    assert rows_of(sweeps.search(spark, SPACE, surface, 6, 2, 2, 1, 4000)) == rows_of(sweeps.search(spark, SPACE, spread, 6, 2, 2, 1, 4000))


def test_proposals_of_odd_tables(spark):
    trials = surface(sweeps.draws(spark, SPACE, 12, 5))
    lost = trials.withColumn("loss", F.when(F.col("trial") == 3, None).when(F.col("trial") == 4, float("nan")).when(F.col("trial") == 5, float("inf")).otherwise(F.col("loss")))
    kept = lost.where("trial NOT IN (3, 4, 5)")
    assert rows_of(sweeps.proposals(lost, SPACE, 2, 5, 2000)) == rows_of(sweeps.proposals(kept, SPACE, 2, 5, 2000))
    assert [r[0] for r in rows_of(sweeps.proposals(lost, SPACE, 2, 5, 2000))] == [12, 13]
    for few in (trials.limit(0), trials.where("trial = 0"), trials.withColumn("loss", F.lit(None).cast("double"))):
        assert [r["improvement"] for r in sweeps.proposals(few, SPACE, 3, 5, 2000).collect()] == [None] * 3
    assert sweeps.proposals(trials, SPACE, 2, 5, 2000, most=6).count() == 2
    # a list of four settings, of which three have been tried
    choices = {"k": ("p", "q", "r", "s")}
    tried = spark.createDataFrame([(0, "p", 1.0), (1, "q", 2.0), (2, "r", 3.0)], "trial long, k string, loss double")
    assert [r["k"] for r in sweeps.proposals(tried, choices, 3, 5, 500).collect()] == ["s"]


def test_equal_losses(spark):
    flat = sweeps.draws(spark, SPACE, 8, 5).withColumn("loss", F.lit(1.0))
    assert sweeps.proposals(flat, SPACE, 2, 5, 1000).count() == 2
