from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import mixing
from tests.llm.conftest import same


def test_edge_cases_equal_sql(edge, oracle):
    got = mixing.mix(edge)
    same(got.select("doc_id", "size", "source_size", "target", "taken", "copies").collect(), oracle(edge, mixing.ORACLE))
    assert got.count() == edge.count()
    again = mixing.mix(edge.repartition(7))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect()))


def test_empty(empty):
    assert mixing.mix(empty).collect() == []
    assert mixing.repeat(empty, mixing.mix(empty)).collect() == []


def filled(sizes, weights, times=3.0):
    """Resharing the excess until none is above."""
    target, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = [s for s in sizes if s not in full]
        left = sum(sizes.values()) - sum(times * sizes[s] for s in full)
        total = sum(weights[s] for s in free)
        target = {s: times * sizes[s] if s in full else left * weights[s] / total for s in sizes}
        above = {s for s in free if target[s] > times * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [[100, 1, 1, 50, 3], [10, 10, 10], [1, 1000], [5], [1, 1, 1, 1, 1, 1000], [0, 4, 9]])
def test_targets(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    weights = {s: float(i % 3 + 1) for i, s in enumerate(named)}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in named.items()], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(named, weights))


def test_taken_words_come_near(spark):
    rows = [(i, "w " * (5 + i * i % 40), f"s{0 if i % 3 else i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = defaultdict(int)
    for r in mixing.mix(docs).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sums[r["source"], r["target"]] += r["taken"]
    for (_, target), taken in sums.items():
        assert abs(taken - target) <= 45 / 2 + 1e-6


def test_inclusion_follows_odds(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("odds"))
    half = lambda s: s.withColumn("weight", F.when(F.col("source") == "a", 1.0).otherwise(3.0))
    taken = mixing.mix(docs, weights=half, odds_col="odds").where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("m")).collect()
    share = {r["odd"]: r["m"] for r in taken}
    assert (share[0] + share[1]) / 2 == pytest.approx(0.5, abs=0.01)
    assert share[0] > 0.62 and share[1] < 0.38


def test_repeat(edge):
    mixed = mixing.mix(edge)
    out = mixing.repeat(edge, mixed)
    assert out.columns == edge.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
