import random

import pytest

from stratapanel.operators import robust_losses, scans


def rows_of(seed, runs):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), rng.uniform(-2, 9), rng.uniform(0, 9), rng.uniform(0, 9)])
    return [(r, i, value()) for r, n in runs.items() for i in range(n)]


def folded(rows, momentum, leak):
    out, state = {}, {}
    for r, i, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        ema, peak = state.get(r, (None, 0.0))
        if v is not None and v == v:
            ema = v if ema is None else ema + momentum * (v - ema)
        peak = peak * leak if ema is None else max(peak * leak, ema)
        state[r] = out[r, i] = (ema, peak)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("runs", [{"a": 900}, {"a": 5, "b": 700, "c": 1, "d": 90, None: 40}, {f"r{i:03}": 3 for i in range(200)}, {}])
def test_one_run_over_many_partitions(spark, partitions, runs):
    rows = rows_of(3, runs)
    log = spark.createDataFrame(rows, "run string, i long, l double").repartition(4)
    got = {(r["run"], r["i"]): (r["ema"], r["peak"]) for r in robust_losses.gates(log, "i", "l", "run", 0.2, 0.9, partitions).collect()}
    expected = folded(rows, 0.2, 0.9)
    assert set(got) == set(expected)
    for k, (ema, peak) in expected.items():
        assert got[k][1] == pytest.approx(peak, rel=1e-9) and (got[k][0] == ema if ema is None else got[k][0] == pytest.approx(ema, rel=1e-9))


def test_long_runs_are_spread(spark):
    rows = scans.spread(spark.createDataFrame(rows_of(1, {"a": 2000}), "run string, i long, l double"), "run", "i", ["l"], 8)
    assert rows.select("pid").distinct().count() >= 6


@pytest.mark.parametrize("fold", [scans.moving_average(0.3), scans.leaking_peak(0.8)])
def test_maps_compose(fold):
    rng = random.Random(0)
    for _ in range(200):
        values = [rng.choice([None, rng.uniform(0, 5)]) for _ in range(rng.randint(0, 12))]
        for state in (fold.start, rng.uniform(0, 5)):
            image, x = fold.identity, state
            for v in values:
                image, x = fold.extend(image, v), fold.step(x, v)
            assert fold.apply(image, state) == pytest.approx(x)
