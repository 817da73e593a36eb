"""Exact quantiles of columns whose distinct values don't fit one task.

A global ``percentile`` merges a map of all distinct values in one buffer.  Here the
distinct values of all columns are counted in a shuffle, dealt to bins between
approximate quantiles, and only the bins that hold a wanted rank are ranked.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a column, a power of two; the bounds only have to be about even for even work.
BINS = 1024
#: Distinct values, of all columns together, that are ranked as one bin a column.
ONE_BIN = 100_000


def _bin(x: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are at most x, by binary search (bounds are BINS - 1 at most, padded with null)."""
    steps = F.array(*(F.lit(BINS >> k) for k in range(1, BINS.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(bounds, low + s - 1) <= x, low + s).otherwise(low))


def in_bins(counts: DataFrame, columns: int = 1) -> DataFrame:
    """Rows (c, x, ...), x distinct for each c, with the bin of x: bins are in order of x and hold about as many rows each.

    The bounds are read first, so a row's bin is the same in every plan that uses the result.
    """
    even = [k / BINS for k in range(1, BINS)]
    sketches = counts.where(~F.isnan("x")).groupBy("c").agg(F.percentile_approx("x", even, 10 * BINS).alias("bounds")).collect()
    bounds = {r["c"]: sorted(set(r["bounds"])) for r in sketches}
    edges = counts.sparkSession.createDataFrame([(i, bounds.get(i, [])) for i in range(columns)], "c int, bounds array<double>")
    return counts.join(F.broadcast(edges), "c").select(*counts.columns, _bin(F.col("x"), F.col("bounds")).alias("bin"))


def _ranks(n: int, p: float, discrete: bool) -> tuple[int, int, float]:
    """The two ranks (from 0) that a quantile lies between, and how far."""
    if discrete:  # the first value whose share of rows at or below it reaches p
        rank = max(ceil(p * n) - 1, 0)
        return rank, rank, 0.0
    at = p * (n - 1)
    return floor(at), ceil(at), at - floor(at)


def exact_quantiles(df: DataFrame, values: dict[str, Column], probabilities: list[float], discrete: bool = False) -> dict[str, list[float] | None]:
    """Quantiles of each column at each probability, linearly interpolated or, if ``discrete``, values that occur.

    Nulls don't count; NaN is the greatest value; a column without values gets None.  Up
    to ONE_BIN distinct values are ranked at once; more are dealt to bins before.
    The driver sees one count for each bin and the values asked for, whatever the
    number of rows.
    """
    names = list(values)
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("c"), values[c].cast("double").alias("x")) for i, c in enumerate(names)))))
    counts = cells.where("x IS NOT NULL").groupBy("c", "x").agg(F.count("*").alias("n")).persist()
    try:
        totals: dict[int, list[tuple[int, int]]] = {}
        columns = counts.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
        if sum(r["distinct"] for r in columns) <= ONE_BIN:
            binned = counts.withColumn("bin", F.lit(0))
            totals.update((r["c"], [(0, r["n"])]) for r in columns)
        else:
            binned = in_bins(counts, len(names))
            for r in binned.groupBy("c", "bin").agg(F.sum("n").alias("n")).sort("c", "bin").collect():
                totals.setdefault(r["c"], []).append((r["bin"], r["n"]))
        sizes = {c: sum(n for _, n in bins) for c, bins in totals.items()}
        places = {c: [_ranks(n, p, discrete) for p in probabilities] for c, n in sizes.items()}
        wanted = []
        for c, bins in totals.items():
            ranks, start, k = sorted({r for low, high, _ in places[c] for r in (low, high)}), 0, 0
            for b, n in bins:
                first = k
                while k < len(ranks) and ranks[k] < start + n:
                    k += 1
                if k > first:
                    wanted.append((c, b, start, ranks[first:k]))
                start += n
        at = df.sparkSession.createDataFrame(wanted, "c int, bin int, start long, ranks array<long>")
        order = Window.partitionBy("c", "bin").orderBy("x")
        ranked = binned.join(F.broadcast(at), ["c", "bin"]).withColumn("end", F.col("start") + F.sum("n").over(order))
        held = F.filter("ranks", lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))
        found = {(r["c"], r["rank"]): r["x"] for r in ranked.select("c", F.explode(held).alias("rank"), "x").collect()}
    finally:
        counts.unpersist()

    def value(c: int, low: int, high: int, part: float) -> float:
        a, b = found[c, low], found[c, high]
        return a if part == 0 or a == b else a + (b - a) * part

    return {name: [value(i, *place) for place in places[i]] if i in places else None for i, name in enumerate(names)}
