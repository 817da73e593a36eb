import math

import pytest
from pyspark.sql import functions as F

from stratapanel.errors import DataLeakageError, DataStarvationError, NumericalSanityError, TemporalHoleError
from stratapanel.functions import calendar
from stratapanel.functions.elementary import asinh, clamp, log_cosh, poisoned, sigmoid, silu, softplus
from stratapanel.operators import audit, diagnostics, fingerprint, metrics, panel, revin, robust_losses, schedules, windows
from stratapanel.operators import forecast as fc
from stratapanel.sources import generators, tables
from stratapanel.spec import PanelSpec, Partition

SPEC = PanelSpec("month_id", "entity", ("y",), ("f",))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(t, e, float((t * 7 + e * 3) % 11), 1.0) for t in range(1, 41) for e in (1, 2, 3)]
    return spark.createDataFrame(rows, "month_id int, entity int, y double, f double")


def test_dense_panels(spark):
    spec = PanelSpec("month_id", "_first", ("y",))
    rows = spark.createDataFrame([(3, 1, 2.0), (5, 1, None), (4, 2, 1.0)], "month_id int, _first int, y double")
    entities = spark.createDataFrame([(1,), (2,), (3,), (3,)], "_first int")
    held = lambda low, high: {(t, e, {(3, 1): 2.0, (4, 2): 1.0}.get((t, e), 0.0)) for t in range(low, high + 1) for e in (1, 2, 3)}
    for span, expected in ((None, held(3, 5)), ((2, 6), held(2, 6)), (rows.agg(F.min("month_id"), F.lit(7)), held(3, 7))):
        found = [tuple(r) for r in panel.densify(rows, entities, spec, span=span).collect()]
        assert set(found) == expected and len(found) == len(expected)
    assert panel.densify(rows.limit(0), entities, spec).count() == 0
    assert panel.densify(rows, entities.limit(0), spec).count() == 0


def test_elementary(spark):
    xs = [-1e9, -50.0, -1.0, 0.0, 0.5, 700.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    x = F.col("x")
    for r in df.select("x", asinh(x).alias("a"), softplus(x).alias("s"), sigmoid(x).alias("g"), silu(x).alias("u"), log_cosh(x).alias("l")).collect():
        v = r["x"]
        assert r["a"] == pytest.approx(math.asinh(v))
        assert r["s"] == pytest.approx(max(v, 0) + math.log1p(math.exp(-abs(v))))
        g = 1 / (1 + math.exp(-v)) if v > -700 else 0.0
        assert r["g"] == pytest.approx(g, abs=1e-12) and r["u"] == pytest.approx(v * g, abs=1e-6)
        assert r["l"] == pytest.approx(abs(v) + math.log1p(math.exp(-2 * abs(v))) - math.log(2), abs=1e-9)
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double").coalesce(1)
    assert [r[0] for r in bad.select(poisoned(x)).collect()] == [True, True, True, False]
    low = [r[0] for r in bad.select(clamp(x, 0.0, 2.0)).collect()]
    assert math.isnan(low[0]) and low[1:] == [2.0, None, 1.0]


def test_calendar(spark):
    df = spark.sql("SELECT date'1980-01-01' AS a, date'2024-03-05' AS b")
    r = df.select(calendar.month_id(F.col("a")), calendar.month_id(F.col("b")), calendar.day_id(F.col("a")), calendar.week_id(F.col("a")), calendar.month_end(calendar.month_id(F.col("b"))).cast("string"), calendar.date_of_day(calendar.day_id(F.col("b"))).cast("string")).first()
    assert tuple(r) == (1, 531, 1, 1, "2024-03-31", "2024-03-05")
    assert calendar.resolution("month_id") == "month" and calendar.resolution_of_level("pgd") == "day" and calendar.cyclic(F.lit(1), "year") == {}
    with pytest.raises(ValueError):
        calendar.resolution("t")
    back = spark.range(1).select(calendar.cyclic(F.lit(-1), "month")["month_sin"]).first()[0]
    assert back == pytest.approx(math.sin(2 * math.pi * 10 / 12))


def test_gates(spark, frame):
    audit.check_schema(frame, SPEC)
    with pytest.raises(KeyError):
        audit.check_schema(frame.drop("y"), SPEC)
    audit.check_contiguity(frame, SPEC)
    with pytest.raises(TemporalHoleError, match="102"):
        audit.check_ids(spark, [100, 101, 103, 104])
    audit.check_boundary(frame, SPEC, 40)
    with pytest.raises(DataLeakageError):
        audit.check_boundary(frame, SPEC, 39)
    with pytest.raises(DataStarvationError):
        audit.check_boundary(frame, SPEC, 41)
    with pytest.raises(DataLeakageError):
        audit.check_leakage(frame.where("month_id < 20"), frame.where("month_id > 18"), SPEC)
    audit.check_leakage(frame.where("month_id < 20"), frame.where("month_id >= 20"), SPEC)
    audit.check_numbers(frame, ["y", "f"])
    with pytest.raises(NumericalSanityError):
        audit.check_numbers(frame.withColumn("y", F.when(F.col("month_id") == 3, float("nan")).otherwise(F.col("y"))), ["y"])
    panel.require_unique_keys(frame, SPEC)
    with pytest.raises(NumericalSanityError):
        panel.require_unique_keys(frame.union(frame), SPEC)


def test_log_features(spark):
    df = spark.createDataFrame([(t, 1, 10.0, 3.0) for t in range(20)], "month_id int, entity int, a double, b double")
    out = panel.log_features(df, ["a"]).first()
    assert out["a"] == pytest.approx(math.log1p(10)) and out["b"] == 3
    with pytest.raises(ValueError):
        panel.log_features(df, ["a"], "LogTransform")


@pytest.mark.parametrize("n", [0, 1, 5, 12])
def test_origin_window(spark, n):
    df = spark.createDataFrame([(t, 1, float(t)) for t in range(60, 130)], "month_id int, entity int, y double")
    got = windows.origin_windows(df, SPEC, "y", 100, 12, 13).where(F.col("sequence_number") == n).first()
    assert got["inputs"] == [float(t) for t in range(88 + n, 100 + n)] and got["origin"] == 100 + n


def test_training_windows_skip_holes(spark):
    df = spark.createDataFrame([(t, 1, float(t)) for t in [*range(1, 6), *range(7, 12)]], "month_id int, entity int, y double")
    starts = [r["start"] for r in windows.training_windows(df, SPEC, "y", 3, 2).orderBy("start").collect()]
    assert starts == [1, 7]
    shifted = windows.training_windows(df, SPEC, "y", 2, 1, shift=1).orderBy("start").first()
    assert (shifted["inputs"], shifted["outputs"]) == ([1.0, 2.0], [4.0])


def test_fingerprint_edge_cases(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0), (2, 2, 4.0)], "month_id int, entity int, y double")
    got = {r["entity"]: r.asDict() for r in fingerprint.fingerprints(df, SPEC).collect()}
    assert (got[1]["y_sigma"], got[1]["y_trend"], got[1]["y_sparsity"]) == (0, 0, 1)
    assert got[2]["y_trend"] == 2 and got[2]["y_mu"] == 3
    with pytest.raises(ValueError):
        fingerprint.fingerprints(df, SPEC, transform="RobustScaler")


def test_no_test_row_reaches_the_fit(frame):
    model = fc.LinearForecaster("NLinearModel", 6, 3).fit(frame, SPEC, "y", (1, 30))
    changed = frame.withColumn("y", F.when(F.col("month_id") > 30, 1e6).otherwise(F.col("y")))
    again = fc.LinearForecaster("NLinearModel", 6, 3).fit(changed, SPEC, "y", (1, 30))
    assert (abs(model.weights - again.weights) < 1e-9).all()


def test_forecasts(frame):
    model = fc.LinearForecaster("DLinearModel", 6, 3).fit(frame, SPEC, "y", (1, 30))
    a = model.predict(frame, SPEC, "y", 31, 2, num_samples=8, seed=1).orderBy("entity", "sequence_number", "step").collect()
    b = model.predict(frame.repartition(7), SPEC, "y", 31, 2, num_samples=8, seed=1).orderBy("entity", "sequence_number", "step").collect()
    assert len(a) == 3 * 2 * 3 and a == b
    assert all(len(r["pred_y"]) == 8 and min(r["pred_y"]) >= 0 for r in a) and len({tuple(r["pred_y"]) for r in a}) > 1
    assert a[0]["month_id"] == 31
    for name, error in (("TFTModel", NotImplementedError), ("Oracle", ValueError)):
        with pytest.raises(error):
            fc.LinearForecaster(name, 6, 3)
    points = fc.last_value(frame, SPEC, "y", Partition((1, 30), (31, 40)), 2)
    out = fc.prediction_frame(points, SPEC, {"y": F.col("prediction") - 100})
    assert {r["pred_y"][0] for r in out.collect()} == {0.0}
    with pytest.raises(NumericalSanityError):
        fc.check_predictions(fc.prediction_frame(points, SPEC, {"y": F.lit(float("nan"))}), ["pred_y"])


def test_linear_forecaster_learns_a_line(spark):
    df = spark.createDataFrame([(t, e, float(10 * e + t)) for t in range(1, 41) for e in range(4)], "month_id int, entity int, y double")
    model = fc.LinearForecaster("NLinearModel", 6, 3, ridge=1e-6).fit(df, SPEC, "y", (1, 37))
    for r in model.predict(df, SPEC, "y", 38).collect():
        assert r["pred_y"][0] == pytest.approx(10 * r["entity"] + r["month_id"], rel=1e-3)


def test_revin_roundtrip(frame):
    z = revin.normalise(frame.select("entity", "month_id", F.log1p("y").alias("x")), ["entity"], "x")
    out = revin.denormalise(z.withColumnRenamed("x", "x0"), [], ["entity"])
    assert out.agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0] < 1e-6
    flat = frame.select("entity", "month_id", F.lit(0.0).alias("x"))
    assert revin.normalise(flat, ["entity"], "x").where("z <> 0").isEmpty()


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (0.0, 0.0), (5.0, 0.0)], "p double, y double")
    got = metrics.metrics(df).first()
    assert got["mse"] == pytest.approx((4 + 25) / 4) and got["ratio"] == 2 and got["n"] == 4
    none = metrics.metrics(df.where("y = 0")).first()
    assert none["ratio"] == 1 and none["pearson"] is None
    four = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (4.0, 1.0), (7.0, 0.0)], "p double, y double")
    assert metrics.calibration(four, 0.5).first()["median_p"] == 2
    s = spark.createDataFrame([(1.0, [0.0, 1.0, 4.0])], "y double, x array<double>")
    pairs = sum(abs(a - b) for a in (0, 1, 4) for b in (0, 1, 4)) / 18
    assert metrics.sample_metrics(s, "x").first()["crps"] == pytest.approx((1 + 0 + 3) / 3 - pairs)


def test_average_precision_of_ties_and_nulls(spark):
    rows = [(0.9, 1.0), (0.9, 0.0), (0.5, 1.0), (None, 1.0), (0.1, 0.0)]
    got = metrics.average_precision(spark.createDataFrame(rows, "p double, y double")).first()[0]
    assert got == pytest.approx((1 * 1 / 2 + 1 * 2 / 3 + 1 * 3 / 5) / 3)


def test_gates_and_plateau_step_by_step(spark):
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate([4.0, 2.0, None, 6.0])] + [("b", 0, None)], "run string, i long, l double")
    got = {(r["run"], r["i"]): (r["ema"], r["peak"]) for r in robust_losses.gates(log, "i", "l", "run", 0.5, 0.9).collect()}
    assert got["a", 1] == pytest.approx((3, 3.6)) and got["a", 2] == pytest.approx((3, 3.24)) and got["a", 3] == pytest.approx((4.5, 4.5))
    assert got["b", 0] == (None, 0)
    rates = schedules.plateau(spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 0.5, 0.5])], "run string, i long, v double"), "run", "i", "v", 0.1, 0.5, 1, 0.06)
    assert [r["lr"] for r in rates.orderBy("i").collect()] == pytest.approx([0.1, 0.1, 0.06, 0.06, 0.06])


def test_reweighting_has_mean_one(frame):
    rows = frame.select("entity", "month_id", (F.col("y") + 0.1).alias("l"))
    assert robust_losses.reweighted(rows, "l").agg(F.avg("w")).first()[0] == pytest.approx(1)
    same = robust_losses.reweighted(frame.withColumn("l", F.lit(2.0)), "l")
    assert same.where("isnan(w) or w is null").isEmpty()


def test_gate_fold(spark):
    df = spark.createDataFrame([("r", 0, 10.0), ("r", 1, 5.0), ("r", 2, 1.0)], "run string, k long, l double")
    ema, peak = 10.0, 10.0
    expected = [(10.0, 0.05)]
    for x in (5.0, 1.0):
        ema += 0.05 * (x - ema)
        peak = max(peak * 0.999, ema)
        expected.append((ema, min(max(1 - ema / (peak + 1e-8), 0.05), 1)))
    got = robust_losses.gates(df, "k", "l", "run").orderBy("k").collect()
    assert [(r["ema"], r["gate"]) for r in got] == [pytest.approx(e) for e in expected]


def test_runs(spark):
    flags = [1, 1, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([("r", i, bool(f)) for i, f in enumerate(flags)], "run string, k int, bad boolean")
    assert [r["run_length"] for r in diagnostics.runs_of(df, "run", "k", "bad").orderBy("k").collect()] == [1, 2, 0, 1, 2, 3, 0]
    assert diagnostics.patience(df, "run", "k", "bad", 3).first()["stopped_at"] == 5


def test_schedules(spark):
    rates = [r["lr"] for r in schedules.warmup_restarts(spark, 120, 1.0).orderBy("epoch").collect()]
    assert rates[0] == 0 and rates[5] == 1 and rates[35] == pytest.approx(1) and rates[95] == pytest.approx(1) and rates[34] < 0.01
    flat = [r["lr"] for r in schedules.warmup_cosine(spark, 320, 1.0).orderBy("epoch").collect()]
    assert flat[10] == 1 and flat[-1] == pytest.approx(1e-6)
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.0, 2.0])], "run string, epoch long, v double")
    assert [r["lr"] for r in schedules.plateau(log, "run", "epoch", "v", 1.0, 0.5, 1, 0.0).orderBy("epoch").collect()] == [1, 1, 1, 0.5, 0.5]
    assert schedules.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6


def test_sources(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "calibration_panel.parquet"))
    got, spec = tables.read_panel(spark, PanelSpec("month_id", "entity", ("y",)), str(tmp_path), "calibration")
    assert spec.features == ("f",) and got.count() == 120
    tables.write_raw_and_log(frame, "y", str(tmp_path / "raw"), str(tmp_path / "log"))
    assert tables.read_csv(spark, str(tmp_path / "log"), "month_id int, entity int, y double, f double").agg(F.max("y")).first()[0] == pytest.approx(math.log1p(10))
    tables.write_metrics(metrics.metrics(frame.select(F.col("y").alias("p"), "y")), str(tmp_path / "m"))
    assert tables.read_metrics(spark, str(tmp_path / "m")).first()["mse"] == 0
    (tmp_path / "a").mkdir()
    for n in ("calibration_model_20240101_000000.pt", "calibration_model_20250101_000000.pt", "validation_model_20260101_000000.pt"):
        (tmp_path / "a" / n).touch()
    assert tables.artifact_timestamp(tables.latest_artifact(spark, str(tmp_path / "a"), "calibration")) == "20250101_000000"
    with pytest.raises(FileNotFoundError):
        tables.latest_artifact(spark, str(tmp_path / "a"), "forecasting")


def test_generators(spark):
    a = generators.clustered_panel(spark, 5, 24)
    assert a.count() == 120 and sorted(a.collect()) == sorted(generators.clustered_panel(spark, 5, 24).repartition(3).collect())
    share = generators.zero_inflated_gamma(spark, 2000).agg(F.avg((F.col("value") == 0).cast("int"))).first()[0]
    assert 0.85 < share < 0.95
    assert generators.fake_batch(spark, 4, 6, 3).count() == 72


def test_streams(spark, tmp_path):
    from stratapanel.streaming import panels

    spark.sql("SELECT timestamp'2024-01-01 10:00' AS ts, 1L AS user_id, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 11:00', 1L, 3.0D UNION ALL SELECT timestamp'2024-01-09 10:00', 1L, 1.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    run = panels.daily_panel(stream).writeStream.format("memory").queryName("daily_panel").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["day_id"], r["y"], r["n"]) for r in spark.table("daily_panel").collect()} >= {(16072, 5.0, 2), (16080, 1.0, 1)}
    spark.createDataFrame([("r", i, f) for i, f in enumerate([True, True, False, True, True])], "run string, k long, bad boolean").write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("run string, k long, bad boolean").parquet(str(tmp_path / "log"))
    run = panels.run_lengths(log, "run", "k", "bad").writeStream.format("memory").queryName("runs").outputMode("update").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["run_length"] for r in spark.table("runs").collect()][-1] == 2
