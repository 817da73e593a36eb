import math

import pytest
from pyspark.sql import functions as F

from stratapanel.functions.losses import cell_loss, time_aware_weighted_huber

PENALTY = {"zero_threshold": 0.1, "delta": 1.0, "non_zero_weight": 5.0, "false_positive_weight": 2.0, "false_negative_weight": 3.0}
TWEEDIE = {"power": 1.5, "non_zero_weight": 1.0, "zero_threshold": 0.01, "eps": 1e-8}
ZERO = {"zero_weight": 1.0, "count_weight": 1.0, "delta": 0.5, "zero_threshold": 0.01, "eps": 1e-8}
SPIKE = {"alpha": 0.8, "gamma": 2.0, "spike_threshold": 3.0}
QUANTILE = {"tau": 0.75, "non_zero_weight": 5.0, "zero_threshold": 0.1}
# (loss, parameters, [(prediction, truth, value)], tolerance)
GOLDEN = [
    ("WeightedHuberLoss", {"zero_threshold": 0.01, "delta": 1.0, "non_zero_weight": 10.0}, [(0.1, 0, 0.005), (0.6, 0.5, 0.05), (2.0, 0.5, 10.0)], 1e-6),
    ("WeightedHuberLoss", {"zero_threshold": 1.0, "delta": 1.0, "non_zero_weight": 10.0}, [(2.0, 0.5, 1.0)], 1e-6),
    ("WeightedPenaltyHuberLoss", PENALTY, [(0.05, 0.05, 0), (0.6, 0.5, 0.025), (0.5, 0, 0.25), (0, 0.5, 1.875)], 1e-6),
    ("SpikeFocalLoss", SPIKE, [(0.6, 0.5, 0.001637), (3.6, 3.5, 0.0000724), (4.5, 3.5, 0.3196), (1.5, 0.5, 0.02706), (1, 1, 0)], 1e-4),
    ("AsymmetricQuantileLoss", QUANTILE, [(0.5, 1, 1.875), (1.5, 1, 0.625), (0.5, 0, 0.125), (1, 1, 0)], 1e-6),
    ("ZeroInflatedLoss", ZERO, [(0.01, 0, 0.7444), (0.6, 0.5, 0.00742), (0.5, 0.5, 0.0067)], 1e-4),
    ("TweedieLoss", TWEEDIE, [(-20, 0, 0.0002), (1.9560475, 2, 5.6582), (0, 2, 6.4696), (3, 2, 5.783)], 1e-3),
    ("TweedieLoss", TWEEDIE | {"power": 1.2}, [(1.9560475, 2, 10.8835)], 1e-3),
    ("ShrinkageLoss", {"a": 10.0, "c": 0.2}, [(0.5, 0.5, 0), (0.5, 0.4, 0.002689), (0.7, 0.5, 0.02), (0.9, 0.5, 0.1409), (0.1, 0.11, 0.0000149), (0.1, 0.5, 0.1409)], 1e-4),
    ("ShrinkageLoss", {"a": 50.0, "c": 0.2}, [(0.5, 0.4, 0.000067)], 1e-4),
    ("CharbonnierLoss", {}, [(1.0, 1.0, 0.0), (4.0, 1.0, 3 - 1e-4)], 1e-6),
    ("HuberLoss", {"delta": 1.0}, [(0.5, 0, 0.125), (3, 0, 2.5)], 1e-9),
    ("SmoothL1Loss", {"beta": 1.0}, [(0.5, 0, 0.125), (3, 0, 2.5)], 1e-9),
    ("PoissonNLLLoss", {}, [(0.0, 2.0, 1.0), (1.0, 2.0, math.e - 2)], 1e-9),
]


@pytest.mark.parametrize(("name", "parameters", "cases", "tolerance"), GOLDEN)
def test_golden(spark, name, parameters, cases, tolerance):
    df = spark.createDataFrame([(float(p), float(y)) for p, y, _ in cases], "p double, y double").coalesce(1)
    got = [r[0] for r in df.select(cell_loss(name, F.col("p"), F.col("y"), **parameters)).collect()]
    assert got == pytest.approx([v for *_, v in cases], abs=tolerance)


def test_time_aware(spark):
    df = spark.createDataFrame([(0.1, 0.0, 2), (0.6, 0.5, 1), (2.0, 0.0, 0)], "p double, y double, left int")
    terms = time_aware_weighted_huber(F.col("p"), F.col("y"), F.col("left"), 1.0, 10.0, 0.9, 1.0)
    assert df.agg(F.avg(terms[0])).first()[0] == pytest.approx(0.51635, abs=1e-5)


def test_neutral_weights_reduce(spark):
    df = spark.range(200).select((F.rand(1) * 4 - 2).alias("p"), (F.rand(2) * 4 - 2).alias("y"))
    p, y = F.col("p"), F.col("y")
    mean = lambda name, **kw: df.agg(F.avg(cell_loss(name, p, y, **kw))).first()[0]
    plain = mean("HuberLoss", delta=1.0)
    assert mean("WeightedHuberLoss", zero_threshold=0.1, delta=1.0, non_zero_weight=1.0) == pytest.approx(plain)
    assert mean("WeightedPenaltyHuberLoss", **(PENALTY | {"non_zero_weight": 1.0, "false_positive_weight": 1.0, "false_negative_weight": 1.0})) == pytest.approx(plain)
    assert mean("AsymmetricQuantileLoss", tau=0.5, non_zero_weight=1.0, zero_threshold=0.1) == pytest.approx(mean("L1Loss") / 2)


def test_bad_parameters():
    with pytest.raises(ValueError):
        cell_loss("NoLoss", None, None)
