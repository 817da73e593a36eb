import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.functions.losses import CELLWISE, cell_loss, time_aware_weighted_huber
from stratapanel.operators import batches, metrics, windows
from stratapanel.operators.forecast import LinearForecaster, log_mean_baseline
from stratapanel.operators.networks import SLOPES, BlockNetwork, dropout
from stratapanel.operators.scaling import GroupedScaler, Scaler
from stratapanel.operators.sums import tree_sum
from stratapanel.operators.training import NetworkForecaster, Optimizer, clipped, stops_at
from stratapanel.sources import artifacts
from stratapanel.spec import OPTIMIZERS, PanelSpec

SPEC = PanelSpec("month_id", "entity", ("y",), ("f", "g"))


@pytest.fixture(scope="module")
def frame(spark):
    """A target that follows yesterday's covariate and the entity's level."""
    rng = np.random.default_rng(0)
    rows = []
    for e in range(6):
        f = rng.normal(size=61)
        rows += [(t, e, float(5 + e + 2 * f[t - 1] + math.sin(t * math.pi / 6)), float(f[t]), float(t % 5)) for t in range(1, 61)]
    return spark.createDataFrame(rows, "month_id int, entity int, y double, f double, g double").repartition(4)


@pytest.fixture(scope="module")
def level(spark):
    return spark.createDataFrame([(e, float(e)) for e in range(6)], "entity int, level double")


def test_windows_of_vectors(frame):
    rows = {(r["month_id"], r["entity"]): r for r in frame.collect()}
    for w in windows.training_windows(frame, SPEC, "y", 4, 2, time_range=(1, 20), features=("f", "g")).collect():
        at = [rows[w["start"] + k, w["entity"]] for k in range(6)]
        assert w["inputs"] == [r["y"] for r in at[:4]] and w["outputs"] == [r["y"] for r in at[4:]]
        assert w["past"] == [x for r in at[:4] for x in (r["f"], r["g"])]
    for w in windows.origin_windows(frame, SPEC, "y", 30, 4, 3, ("f", "g")).collect():
        at = [rows[w["origin"] - 4 + k, w["entity"]] for k in range(4)]
        assert w["inputs"] == [r["y"] for r in at] and w["past"] == [x for r in at for x in (r["f"], r["g"])]
    nulls = frame.withColumn("f", F.when(F.col("month_id") != 3, F.col("f")))
    assert {w["past"][4] for w in windows.training_windows(nulls, SPEC, "y", 4, 2, time_range=(1, 6), features=("f", "g")).collect()} == {0.0}


def test_static_covariates_by_either_join(frame, level, monkeypatch):
    rows = windows.training_windows(frame, SPEC, "y", 4, 2)
    some = level.where("entity <> 2")
    sent = windows.with_static(rows, SPEC, some, ["level"])
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(windows, "STATIC_ROWS", 0)
    shuffled = windows.with_static(rows, SPEC, some, ["level"])
    assert sorted(sent.collect()) == sorted(shuffled.collect())
    assert {tuple(r["static"]) for r in sent.where("entity = 2").collect()} == {(0.0,)}


def test_covariates_change_and_improve_forecasts(frame, level):
    def fitted(**more):
        return LinearForecaster("NLinearModel", 6, 1, **more).fit(frame, SPEC, "y", (1, 48), level)

    def error(model, panel):
        cells = model.predict(panel, SPEC, "y", 49, 12, static=level).join(panel, ["month_id", "entity"])
        return cells.agg(F.avg((F.col("pred_y")[0] - F.col("y")) ** 2)).first()[0]

    plain, rich = fitted(), fitted(features=("f", "g"), static=("level",))
    assert len(rich.weights) == 6 + 12 + 1 + 1
    assert error(rich, frame) < 0.2 * error(plain, frame)
    changed = frame.withColumn("f", 2 * F.col("f"))
    assert error(rich, changed) > 5 * error(rich, frame)  # as y follows 2 f
    assert error(plain, changed) == error(plain, frame)
    later = frame.withColumn("f", F.when(F.col("month_id") >= 49, 1e6).otherwise(F.col("f")))
    first = [sorted(rich.predict(x, SPEC, "y", 49, 1, static=level).collect()) for x in (frame, later)]
    assert first[0] == first[1]  # nothing from the origin on is read
    with pytest.raises(ValueError, match="static"):
        LinearForecaster("NLinearModel", 6, 1, static=("level",)).fit(frame, SPEC, "y", (1, 48))


def test_gram_blocks_equal_least_squares(frame, level, monkeypatch):
    from stratapanel.operators import forecast

    model = LinearForecaster("DLinearModel", 6, 3, features=("f", "g"), static=("level",)).fit(frame, SPEC, "y", (1, 48), level)
    monkeypatch.setattr(forecast, "BLOCK", 4)
    small = LinearForecaster("DLinearModel", 6, 3, features=("f", "g"), static=("level",)).fit(frame, SPEC, "y", (1, 48), level)
    rows = windows.with_static(windows.training_windows(frame, SPEC, "y", 6, 3, time_range=(1, 48), features=("f", "g")), SPEC, level, ["level"]).collect()
    a, offset = model.design(*(np.array([r[c] for r in rows]) for c in ("inputs", "past", "static")))
    b = np.array([r["outputs"] for r in rows]) - offset
    expected = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ b)
    assert np.allclose(model.weights, expected) and np.allclose(small.weights, expected)
    assert np.allclose(model.residuals, np.sqrt(((b - a @ expected) ** 2).mean(axis=0)))
    monkeypatch.setattr(forecast, "MOST_COLUMNS", 20)
    with pytest.raises(ValueError, match="columns"):
        LinearForecaster("DLinearModel", 6, 3, features=("f", "g")).fit(frame, SPEC, "y", (1, 48))


def test_tree_sum(spark):
    rows = spark.createDataFrame([(k, np.arange(5.0 + k).tobytes()) for k in (-1, 0, 3) for _ in range(20)], "k int, v binary").repartition(7)
    found = tree_sum(rows)
    assert set(found) == {-1, 0, 3} and all((v == 20 * np.arange(5.0 + k)).all() for k, v in found.items())


def test_saved_models(spark, frame, level, tmp_path):
    root = str(tmp_path / "models")
    target, features = Scaler("AsinhTransform->StandardScaler", ["y"]).fit(frame), GroupedScaler({"MinMaxScaler": ["f"]}, "QuantileUniform", ["f", "g"]).fit(frame)
    linear = LinearForecaster("DLinearModel", 6, 3, features=("f",), static=("level",)).fit(frame, SPEC, "y", (1, 48), level)
    network = NetworkForecaster(BlockNetwork(6, 3, features=1, static=1, stacks=("trend", "generic"), width=4), "MSELoss", Optimizer("Adam", 0.01), epochs=2, features=("f",), static=("level",)).fit(frame, SPEC, "y", (1, 48), static=level)
    for stamp, model in (("20240101_000000", linear), ("20240102_000000", network)):
        path = artifacts.save_model(spark, model, root, "test", stamp, {"target": target, "features": features}, {"steps": [1, 2, 3]})
        assert artifacts.latest_model(spark, root, "test") == f"file:{path}"
        again, scalers, manifest = artifacts.load_model(spark, path, {"target": "AsinhTransform->StandardScaler"})
        assert manifest == {"steps": [1, 2, 3]} and type(again) is type(model)
        pair = [sorted(m.predict(frame, SPEC, "y", 49, 2, static=level).collect()) for m in (model, again)]
        assert pair[0] == pair[1] and pair[0]
        for mine, theirs in ((target, scalers["target"]), (features, scalers["features"])):
            assert sorted(mine.transform(frame).collect()) == sorted(theirs.transform(frame).collect())
    with pytest.raises(ValueError, match="configured"):
        artifacts.load_model(spark, path, {"target": "StandardScaler"})
    with pytest.raises(FileNotFoundError, match="other"):
        artifacts.load_model(spark, path, {"other": "StandardScaler"})
    with pytest.raises(FileExistsError):
        artifacts.save_model(spark, network, root, "test", "20240102_000000")
    with pytest.raises(RuntimeError):
        artifacts.save_model(spark, LinearForecaster("NLinearModel", 2, 1), root, "test", "20240103_000000")


def test_half_written_artifacts_are_passed_over(spark, frame, tmp_path):
    root = str(tmp_path / "models")
    model = LinearForecaster("NLinearModel", 6, 3).fit(frame, SPEC, "y", (1, 48))
    whole = artifacts.save_model(spark, model, root, "test", "20240101_000000")
    half = artifacts.save_model(spark, model, root, "test", "20240102_000000")
    (tmp_path / "models" / half.rpartition("/")[2] / artifacts.MARKER).unlink()
    assert artifacts.latest_model(spark, root, "test") == f"file:{whole}"
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, half)
    assert artifacts.save_model(spark, model, root, "test", "20240102_000000") == half  # written anew
    assert artifacts.latest_model(spark, root, "test") == f"file:{half}"
    with pytest.raises(FileNotFoundError):
        artifacts.latest_model(spark, root, "other")


PARAMETERS = {
    "WeightedHuberLoss": {"zero_threshold": 0.1, "delta": 0.7, "non_zero_weight": 5.0},
    "WeightedPenaltyHuberLoss": {"zero_threshold": 0.1, "delta": 0.7, "non_zero_weight": 5.0, "false_positive_weight": 2.0, "false_negative_weight": 3.0},
    "TimeAwareWeightedHuberLoss": {"zero_weight": 1.0, "non_zero_weight": 10.0, "decay_factor": 0.9, "delta": 0.7},
    "SpikeFocalLoss": {"alpha": 0.8, "gamma": 2.0, "spike_threshold": 0.5},
    "TweedieLoss": {"power": 1.4, "non_zero_weight": 2.0, "zero_threshold": 0.1, "false_positive_weight": 1.5, "false_negative_weight": 2.5},
    "AsymmetricQuantileLoss": {"tau": 0.75, "non_zero_weight": 5.0, "zero_threshold": 0.1},
    "ZeroInflatedLoss": {"zero_weight": 1.0, "count_weight": 2.0, "delta": 0.5, "zero_threshold": 0.1},
    "ShrinkageLoss": {"a": 10.0, "c": 0.2},
    "HuberLoss": {"delta": 0.7},
    "SmoothL1Loss": {"beta": 0.7},
}


@pytest.mark.parametrize("name", sorted(SLOPES))
def test_losses_equal_columns_and_slopes_equal_differences(spark, name):
    rng = np.random.default_rng(1)
    y = np.where(rng.random((40, 6)) < 0.4, 0.0, rng.uniform(-1.5, 3, (40, 6)))
    p = rng.uniform(-1.5, 3, y.shape)
    left, kw = np.arange(5, -1, -1), PARAMETERS.get(name, {})
    value, slope = SLOPES[name](p, y, left, **kw)
    h = 1e-6
    differences = (SLOPES[name](p + h, y, left, **kw)[0] - SLOPES[name](p - h, y, left, **kw)[0]) / (2 * h)
    assert np.allclose(slope, differences, rtol=1e-4, atol=1e-5)
    rows = spark.createDataFrame([(*x,) for x in zip(range(p.size), p.ravel().tolist(), y.ravel().tolist(), np.tile(left, 40).tolist())], "i int, p double, y double, left int")
    column = time_aware_weighted_huber(F.col("p"), F.col("y"), F.col("left"), **kw)[0] if name == "TimeAwareWeightedHuberLoss" else cell_loss(name, F.col("p"), F.col("y"), **kw)
    assert np.allclose([r[1] for r in rows.select("i", column).orderBy("i").collect()], value.ravel(), atol=1e-9)
    assert set(CELLWISE) <= set(SLOPES)


@pytest.mark.parametrize("network", [BlockNetwork(5, 3, 1, 2, ("linear",), from_last=True), BlockNetwork(5, 3, 1, 2, ("generic", "trend"), blocks=2, layers=2, width=4), BlockNetwork(5, 3, 0, 0, ("seasonality", "generic"), layers=1, width=6, dropout=0.4, from_last=True), BlockNetwork(4, 2, 0, 1, ("trend", "linear"), layers=0)])
def test_gradients_equal_differences(network):
    rng = np.random.default_rng(2)
    params = {k: rng.normal(size=s) for k, s in network.shapes().items()}
    x, more = rng.normal(size=(7, network.input_length)), rng.normal(size=(7, network.input_length * network.features + network.static))
    target = rng.normal(size=(7, network.output_length))
    mask = dropout(np.arange(7), 3, network.dropout) if network.dropout else None
    loss = lambda held: ((network.forward(held, x, more, mask)[0] - target) ** 2).sum()
    out, tape = network.forward(params, x, more, mask)
    grads = network.backward(params, tape, 2 * (out - target))
    assert set(grads) == set(params)
    for k, p in params.items():
        for at in list(np.ndindex(p.shape))[:6]:
            moved = [{**params, k: p + s * 1e-6 * (np.indices(p.shape) == np.array(at).reshape(-1, *[1] * p.ndim)).all(axis=0)} for s in (1, -1)]
            assert grads[k][at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-6, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("name", sorted(OPTIMIZERS))
def test_optimisers_equal_their_recurrences(name):
    """One weight, gradients of its own; each recurrence written out as published."""
    lr, wd, mom, alpha, b1, b2, eps = 0.1, 0.05, 0.9, 0.95, 0.9, 0.999, 1e-8
    opt = Optimizer(name, lr, wd, mom if name in ("SGD", "RMSprop") else 0.0, alpha)
    w, m, v, buf = 1.0, 0.0, 0.0, 0.0
    params = {"w": np.array([1.0])}
    for t in range(1, 13):
        raw = math.sin(t) + w
        params = opt.step(params, {"w": np.array([math.sin(t) + params["w"][0]])})
        g = raw if name == "AdamW" else raw + wd * w
        if name == "SGD":
            buf = mom * buf + g
            w -= lr * buf
        elif name == "RMSprop":
            v = alpha * v + (1 - alpha) * g * g
            buf = mom * buf + g / (math.sqrt(v) + eps)
            w -= lr * buf
        else:
            w = w - lr * wd * w if name == "AdamW" else w
            m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
            mh, top = m / (1 - b1**t), 2 / (1 - b2) - 1
            rho = top - 2 * t * b2**t / (1 - b2**t)
            if name != "RAdam":
                w -= lr * mh / (math.sqrt(v / (1 - b2**t)) + eps)
            elif rho > 5:
                w -= lr * mh * math.sqrt((rho - 4) * (rho - 2) * top / ((top - 4) * (top - 2) * rho)) * math.sqrt(1 - b2**t) / (math.sqrt(v) + eps)
            else:
                w -= lr * mh
        assert params["w"][0] == pytest.approx(w, rel=1e-9)
    with pytest.raises(ValueError):
        Optimizer("Lion", 0.1)


def test_clipping():
    grads = {"a": np.array([3.0]), "b": np.array([4.0])}
    assert clipped(grads, 1.0)["a"][0] == pytest.approx(0.6) and clipped(grads, 10.0) is grads and clipped(grads, None) is grads


@pytest.mark.parametrize("losses, patience, delta, stop", [([3, 2, 1, 1, 1], 2, 0, 4), ([3, 2, 1, 0.95, 0.9], 2, 0.1, 4), ([1, 2, 3], None, 0, None), ([1, 2, 0.5, 2], 2, 0, None), ([1.0], 1, 0, None), ([1, 1], 1, 0, 1)])
def test_early_stopping(losses, patience, delta, stop):
    assert stops_at(losses, patience, delta) == stop


def small_model(**more):
    network = BlockNetwork(6, 3, features=2, static=1, stacks=("trend", "generic"), width=8, from_last=True, dropout=more.pop("rate", 0.0))
    return NetworkForecaster(network, "HuberLoss", Optimizer("Adam", 0.02), {"delta": 1.0}, features=("f", "g"), static=("level",), seed=4, **more)


def test_training(spark, frame, level):
    model = small_model(epochs=6, clip=5.0).fit(frame, SPEC, "y", (1, 48), (43, 60), level)
    log = model.log_table(spark).orderBy("epoch").collect()
    assert [r["epoch"] for r in log] == list(range(6)) and log[-1]["train_loss"] < 0.8 * log[0]["train_loss"]
    best = min(range(6), key=lambda i: log[i]["val_loss"])
    assert [i for i, r in enumerate(log) if r["is_best"]][-1] == best
    # the kept weights are those that the best epoch started from
    rows = model.windows(frame, SPEC, "y", (43, 60), level).withColumn("trains", F.lit(True))
    assert model.gradient(rows, model.weights, 0)[1] == pytest.approx(log[best]["val_loss"], rel=1e-9)
    again = small_model(epochs=6, clip=5.0).fit(frame.repartition(9), SPEC, "y", (1, 48), (43, 60), level)
    assert all(np.allclose(model.weights[k], again.weights[k], rtol=1e-6, atol=1e-9) for k in model.weights)


def test_training_stops_as_the_log_says(spark, frame, level):
    model = small_model(epochs=8, patience=1, min_delta=0.15, keep="last").fit(frame, SPEC, "y", (1, 48), (43, 60), level)
    losses = [r[2] for r in model.log]
    best, stop = float("inf"), None
    for i, x in enumerate(losses):
        if x < best - 0.15:
            best = x
        else:
            stop = i
            break
    assert stop is not None and stop == len(losses) - 1 < 7


def test_training_in_batches(frame, level):
    model = small_model(epochs=2, batch_size=100).fit(frame, SPEC, "y", (1, 48), (43, 60), level)
    assert len(model.log) == 2 and model.optimizer.steps == 2 * (6 * 40 // 100) and model.log[1][1] < model.log[0][1]
    with pytest.raises(ValueError, match="batch"):
        small_model(epochs=1, batch_size=10_000).fit(frame, SPEC, "y", (1, 48), static=level)


def test_block_network_beats_the_baseline(spark):
    rows = [(t, e, float(round(20 + 15 * e + 15 * math.sin(2 * math.pi * (t + e) / 6)))) for t in range(1, 73) for e in range(8)]
    panel = spark.createDataFrame(rows, "month_id int, entity int, y double").withColumn("z", F.log1p("y")).coalesce(4)
    model = NetworkForecaster(BlockNetwork(12, 6, stacks=("trend", "seasonality"), width=24, from_last=True), "MSELoss", Optimizer("Adam", 0.02), epochs=40, seed=1).fit(panel, SPEC, "z", (1, 60))
    found = model.predict(panel, SPEC, "z", 61).join(panel, ["month_id", "entity"]).withColumn("p", F.expm1(F.col("pred_z")[0].cast("double")))
    base = panel.where("month_id between 61 and 66").join(log_mean_baseline(panel, SPEC, "y", (1, 60)).withColumnRenamed("prediction", "p"), "entity")
    assert metrics.metrics(found).first()["msle"] < 0.5 * metrics.metrics(base).first()["msle"]


def test_dropout_samples(frame, level):
    model = small_model(epochs=1, rate=0.3).fit(frame, SPEC, "y", (1, 48), static=level)
    ask = lambda panel, **kw: sorted(map(tuple, model.predict(panel, SPEC, "y", 49, 3, num_samples=16, static=level, **kw).collect()))
    a = ask(frame, mc_dropout=True, seed=2)
    assert a == ask(frame.repartition(5), mc_dropout=True, seed=2) != ask(frame, mc_dropout=True, seed=3)
    assert max(np.std(r[-1]) for r in a) > 0.01
    assert all(np.std(r[-1]) == 0 for r in ask(frame))  # without dropout all samples are the forecast
    model.network = BlockNetwork(**{**model.network.__dict__, "dropout": 0.0})
    assert ask(frame, mc_dropout=True, seed=2) == ask(frame)
    keep = dropout(np.arange(20_000), 1, 0.3)(0, 0, 4)
    assert abs((keep > 0).mean() - 0.7) < 0.01 and abs(keep.mean() - 1) < 0.02


def test_exact_batches(spark):
    rows = spark.range(1003).withColumn("k", F.col("id") % 50).repartition(5)
    found = [batches.epoch_batches(rows, ["id"], 100, epoch).collect() for epoch in (0, 1)]
    for part in found:
        assert sorted(r["batch"] for r in part) == [b for b in range(10) for _ in range(100)]
        assert len({r["id"] for r in part}) == 1000
    assert {(r["id"], r["batch"]) for r in found[0]} != {(r["id"], r["batch"]) for r in found[1]}
    assert {(r["id"], r["batch"]) for r in found[0]} == {(r["id"], r["batch"]) for r in batches.epoch_batches(rows.repartition(2), ["id"], 100, 0).collect()}
    assert sorted(r["batch"] for r in batches.epoch_batches(rows, ["k"], 100, drop_last=False).collect()).count(10) == 3
    assert batches.epoch_batches(rows.where("id < 0"), ["id"], 100).collect() == []
