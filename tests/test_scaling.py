import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators.scaling import GroupedScaler, Scaler, Step, is_chain, load_scaler, parse_chain, save_scaler

SCALERS = ["StandardScaler", "RobustScaler", "MinMaxScaler", "MaxAbsScaler", "AsinhTransform", "LogTransform", "SqrtTransform", "FourthRootTransform", "PassThrough", "YeoJohnson", "AsinhTransform->StandardScaler", "LogTransform->RobustScaler->MinMaxScaler"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, float(i * i % 97), float(100 + i)) for i in range(60)], "i int, a double, b double")


@pytest.mark.parametrize("spec", [*SCALERS, "QuantileUniform", "QuantileNormal"])
def test_roundtrip(frame, spec):
    scaler = Scaler(spec, ["a", "b"]).fit(frame)
    back = scaler.inverse_transform(scaler.transform(frame)).orderBy("i").collect()
    for r, o in zip(back, frame.orderBy("i").collect()):
        assert r["a"] == pytest.approx(o["a"], abs=1e-4) and r["b"] == pytest.approx(o["b"], abs=1e-4)


def test_small_matrices(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], "a double, b double")
    got = Scaler("StandardScaler", ["a", "b"]).fit(df).transform(df).agg(F.avg("a"), F.stddev_pop("a"), F.avg("b")).first()
    assert tuple(got) == pytest.approx((0, 1, 0))
    got = Scaler("MinMaxScaler", ["a"]).fit(df).transform(df).agg(F.min("a"), F.max("a")).first()
    assert tuple(got) == pytest.approx((0, 1))
    df = spark.createDataFrame([(-2.0, 3.0), (-1.0, 1.0), (0.0, 0.0), (1.0, -3.0)], "a double, b double")
    assert Scaler("MaxAbsScaler", ["a", "b"]).fit(df).transform(df).agg(F.max(F.abs("a")), F.max(F.abs("b"))).first() == (1, 1)


def test_fit_is_global_and_transform_does_not_refit(spark):
    rows = [(t, e, t / 23 if e == 0 else 100 + 900 * t / 23) for t in range(24) for e in (0, 1)]
    df = spark.createDataFrame(rows, "time int, entity int, target double")
    scaler = Scaler("MinMaxScaler", ["target"]).fit(df)
    assert scaler.fits["target"][0].center == 0 and scaler.fits["target"][0].scale == 1000
    back = scaler.inverse_transform(scaler.transform(df)).groupBy("entity").agg(F.max("target").alias("m")).orderBy("entity").collect()
    assert [r["m"] for r in back] == pytest.approx([1, 1000])
    first = Scaler("StandardScaler", ["target"]).fit(df.where("time < 12"))
    before = first.fits["target"][0]
    first.transform(df.where("time >= 12")).count()
    assert first.fits["target"][0] == before


def test_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "a double")
    for spec in ("StandardScaler", "RobustScaler", "MinMaxScaler", "MaxAbsScaler"):
        assert Scaler(spec, ["a"]).fit(df).transform(df).where(F.isnan("a") | F.col("a").isNull()).isEmpty()


def test_parsing():
    assert is_chain("A->B") and not is_chain("A")
    assert [s.name for s in parse_chain(" AsinhTransform -> MaxAbsScaler ")] == ["AsinhTransform", "MaxAbsScaler"]
    assert parse_chain({"name": "MinMaxScaler", "kwargs": {"feature_range": (-1, 1)}}) == [Step("MinMaxScaler", {"feature_range": (-1, 1)})]
    assert len(parse_chain({"chain": ["AsinhTransform", "StandardScaler"]})) == 2
    for bad, error in (("", ValueError), ([], ValueError), ("A->", ValueError), (3, TypeError), ({}, ValueError), ("NoScaler", ValueError)):
        with pytest.raises(error):
            parse_chain(bad)
    with pytest.raises(RuntimeError):
        Scaler("StandardScaler", ["a"]).forward("a", None)


def test_groups(frame):
    g = GroupedScaler({"MaxAbsScaler": ["a"]}, all_columns=["a", "b"])
    assert g.mapping() == {"a": "MaxAbsScaler", "b": "RobustScaler"} and not g.is_fitted
    out = g.fit_transform(frame)
    assert g.is_fitted and out.agg(F.max("a")).first()[0] == 1
    assert g.inverse_transform(out).agg(F.max("b")).first()[0] == pytest.approx(159)
    for bad in ({"x": {"scaler": None, "features": ["a"]}}, {"MaxAbsScaler": ["a"], "MinMaxScaler": ["a"]}):
        with pytest.raises(ValueError):
            GroupedScaler(bad)


def test_artifact(spark, frame, tmp_path):
    spec = "AsinhTransform->StandardScaler"
    scaler = Scaler(spec, ["a"]).fit(frame)
    save_scaler(spark, scaler, spec, str(tmp_path / "s"))
    assert load_scaler(spark, str(tmp_path / "s"), spec).parameters() == scaler.parameters()
    with pytest.raises(ValueError):
        load_scaler(spark, str(tmp_path / "s"), "StandardScaler")


def test_exact_quantiles(spark, monkeypatch):
    import random

    import numpy as np

    from stratapanel.operators import quantiles

    rng = random.Random(5)
    rows = [(rng.choice([0.0, 0.0, 1.0, rng.lognormvariate(0, 4)]), float(i % 7), None, None if i % 3 else -float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    values = {name: F.col(name) for name in "abcd"}
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for bins, one in ((1024, 100_000), (1024, 0), (8, 0)):  # at once, in bins, and with many values in a bin
        monkeypatch.setattr(quantiles, "BINS", bins)
        monkeypatch.setattr(quantiles, "ONE_BIN", one)
        got = quantiles.exact_quantiles(df, values, probabilities)
        assert got["c"] is None
        for i, name in enumerate("abcd"):
            if name != "c":
                assert got[name] == pytest.approx(np.quantile([r[i] for r in rows if r[i] is not None], probabilities).tolist())
    held = quantiles.exact_quantiles(df, {"a": F.col("a")}, [0.5, 0.999], discrete=True)["a"]
    assert held == np.quantile([r[0] for r in rows], [0.5, 0.999], method="inverted_cdf").tolist()
    assert quantiles.exact_quantiles(df.where("false"), values, [0.5]) == dict.fromkeys("abcd")
    nans = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "a double")
    assert quantiles.exact_quantiles(nans, {"a": F.col("a")}, [0.0, 0.5]) == {"a": [1.0, 2.0]}


def test_normal_distribution(spark):
    from stratapanel.functions.normal import normal_cdf, normal_quantile

    ps = [1e-12, 1e-9, 1e-7, 1e-4, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.77, 0.93, 0.9999, 1 - 1e-7]
    df = spark.createDataFrame([(p, x) for p, x in zip(ps, [-38.0, -30.0, -7.2, -7.0, -3.0, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.9, 7.3, 40.0])], "p double, x double").coalesce(1)
    for r in df.select("p", "x", normal_quantile(F.col("p")).alias("q"), normal_cdf(F.col("x")).alias("c")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-13)
        assert r["c"] == pytest.approx(math.erfc(-r["x"] / 2**0.5) / 2, rel=1e-7, abs=1e-300)


@pytest.mark.parametrize("spec", ["QuantileUniform", "QuantileNormal", "AsinhTransform->QuantileNormal"])
def test_quantile_scalers_stay_on_the_jvm(spark, spec):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.zeros(300), rng.gamma(2, 50, 700)])
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "x double")
    scaler = Scaler(spec, ["x"]).fit(df.where("not isnan(x)"))
    out = scaler.transform(df.withColumn("was", F.col("x")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    grid, refs = np.quantile(np.arcsinh(values) if "Asinh" in spec else values, np.linspace(0, 1, 1000)), np.linspace(0, 1, 1000)
    rows = out.collect()
    for r in rows:
        if r["was"] is None or r["was"] != r["was"]:
            assert r["x"] is None if r["was"] is None else r["x"] != r["x"]
            continue
        v = np.arcsinh(r["was"]) if "Asinh" in spec else r["was"]
        p = (np.interp(v, grid, refs) - np.interp(-v, -grid[::-1], -refs[::-1])) / 2
        assert r["x"] == pytest.approx(p if spec == "QuantileUniform" else NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-9)
    back = scaler.inverse_samples(out.where("not isnan(x)").withColumn("s", F.array("x", "x")), "x", "s").collect()
    assert all(r["s"] == pytest.approx([r["was"]] * 2, abs=1e-5) for r in back)
    ends = scaler.inverse_samples(spark.createDataFrame([([-1e9, 1e9, None],)], "s array<double>"), "x", "s").first()["s"]
    assert ends[:2] == pytest.approx([values.min(), values.max()]) and ends[2] is None


def test_moments_in_passing(spark, tmp_path):
    from stratapanel.operators import audit
    from stratapanel.sources.tables import read_metrics, write_metrics

    values = [1.0, 2.0, 4.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
    scaler = Scaler("StandardScaler", ["x"]).fit(df.where("x < 10"))
    after, seen = audit.watched_inverse(scaler.transform(df), scaler, ["x"])
    after.write.parquet(str(tmp_path / "out"))
    found = audit.moments(spark, seen, ["x"])
    write_metrics(found, str(tmp_path / "metrics"))
    got = {r["side"]: r for r in read_metrics(spark, str(tmp_path / "metrics")).collect()}
    assert (got["after"]["n"], got["after"]["nan"], got["after"]["inf"]) == (6, 2, 1)
    assert got["after"]["low"] == pytest.approx(1) and got["after"]["high"] == pytest.approx(4) and got["after"]["mean"] == pytest.approx(7 / 3)
    assert got["before"]["mean"] == pytest.approx(0, abs=1e-12) and got["before"]["std"] == pytest.approx(1)
