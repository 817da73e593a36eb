"""Mixing sources to target weights by Pareto order sampling, in SQL functions only.

Every document of a source first gets the whole copies that its source's
repeat rate makes certain.  The rest of a source's target is a sample without
replacement: documents are ranked by random odds over inclusion odds (Rosén's
Pareto sampling), and the ranking is cut where the taken words reach the rest.

The cut needs no sort of a source: ranks are read as integers, summed by their
leading digits, and only the rows that share the cut's digits are looked at more
closely.  So a source with most of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import WORD, cut, documents, meet, near

#: A rank has LEVELS digits of BITS bits; rows that share all of them are sorted.
BITS, LEVELS = 10, 2
#: Words of a document that has the highest inclusion odds.
LONG = 1000


def _unit(id_col: Column, seed: int) -> Column:
    """52 random bits of an id, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")


def ranked_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last.

    ``sources`` has a row for each source; so few rows can be ranked together.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def targets(sources: DataFrame, max_repeats: float = 3.0) -> DataFrame:
    """Adds each source's target: shares by weight, held at ``max_repeats`` times its size.

    Sources in order of room by weight: the first that stay full while the rest
    share by weight are those whose room lies below the resulting level.  This is
    where resharing the excess again and again ends.
    """
    order = Window.orderBy("room", F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.col("source_size") * F.lit(max_repeats)
    return (
        sources.withColumn("full", full)
        .withColumn("room", F.col("full") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("share", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("share") <= F.col("room"), F.struct("room", "share"))).over(everything)["share"])
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("room") < F.col("level")), F.col("full")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def by_size(size: Column) -> Column:
    """Inclusion odds of a document by its words: up to twice those of a fragment, from LONG words on."""
    return 1.0 + F.least(size, F.lit(LONG)) / F.lit(float(LONG))


def mix(docs: DataFrame, weights=ranked_weights, max_repeats: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", odds=by_size, odds_col: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, th (digest of the text), source, size, source_size, target, copies, taken.

    ``weights`` turns a table (source, source_size) into one with a weight for
    each source.  ``odds`` gives a positive factor of each document's inclusion odds
    from its size; ``odds_col`` may name a column that holds it instead.

    Size is the number of words; null and empty texts have size 0 and are never
    sampled.  Null is a source of its own.  Documents of equal rank are ordered by
    id, size and digest of the text; rows alike in all of these are interchangeable.  The sample ends
    with the document whose middle lies before the cut, so that a source misses
    its target by half a document at most.  An empty table gives an empty result;
    other columns of the input are not carried, whatever their names.
    """
    given = [F.col(odds_col).cast("double").alias("odds")] if odds_col else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _unit(F.col(id_col), seed).alias("u"),
        *given,
    )
    rows = cut(rows)
    if not odds_col:
        rows = rows.withColumn("odds", odds(F.col("size")))
    sized = targets(weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), max_repeats)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    plan = (
        sized.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", rest)
        .withColumn("part", F.when(F.col("source_size") > 0, rest / F.col("source_size")).otherwise(0.0))
    )
    plan = cut(plan.withColumnRenamed("source", "s"))  # a row for each source
    unit = (F.col("u") + 0.5) / F.lit(float(2**52))
    ranked = (
        rows.join(near(plan), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rank", F.when((F.col("part") > 0) & (F.col("size") > 0), (unit / (1 - unit)) / (F.col("part") / (1 - F.col("part")) * F.col("odds"))))
        .withColumn("code", F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(float(2 ** (BITS * LEVELS)))).cast("long"))
        .drop("s", "odds")
    )
    # Digit by digit: where does the running sum of a source's words pass its rest?
    state = plan.select(F.col("s"), "rest", F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("words"))
    slim = ranked.where(F.col("code").isNotNull()).select("source", "code", "size")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = F.shiftright("code", shift)
        inside = slim.join(near(state.select("s", "head", "rest", F.col("words").alias("base"))), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("code", shift + BITS) == F.col("head")))
        sums = inside.groupBy("s", at.alias("digit")).agg(F.sum("size").alias("n"), F.first("base").alias("base"), F.first("rest").alias("rest"))
        run = Window.partitionBy("s").orderBy("digit")
        sums = sums.withColumn("until", F.col("base") + F.sum("n").over(run)).where(F.col("until") > F.col("rest"))
        state = cut(sums.groupBy("s").agg(F.min(F.struct("digit", F.col("until") - F.col("n"), "rest")).alias("m")).select("s", F.col("m.digit").alias("head"), F.col("m.col2").alias("words"), F.col("m.rest").alias("rest")))
    state = state.select(F.col("s").alias("cs"), "head", "words", F.lit(True).alias("has_cut"))
    marked = ranked.join(near(state), F.col("source").eqNullSafe(F.col("cs")), "left")
    # A source without a cut takes all that have a rank (its rest is its size, up to rounding).
    kind = F.when(F.col("code").isNull(), 0).when(F.col("has_cut").isNull() | (F.col("code") < F.col("head")), 1).when(F.col("code") > F.col("head"), 0).otherwise(2)
    marked = marked.withColumn("kind", kind)
    edge = Window.partitionBy("source").orderBy("rank", "u", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    out = ["doc_id", "th", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).alias("taken")]
    sure = marked.where("kind < 2").withColumn("copies", F.col("whole") + F.col("kind"))
    last = (
        marked.where("kind = 2")
        .withColumn("till", F.col("words") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
        .withColumn("copies", F.col("whole") + (F.col("till") + F.col("size") / 2 <= F.col("rest")).cast("long"))
    )
    return sure.select(*out).unionByName(last.select(*out))


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` (from the same rows) takes them, all columns kept.

    Rows alike in id and text share what is taken of them.
    """
    by = ["__mix_id", "__mix_th"]
    shares = mixed.groupBy(F.col("doc_id").alias("__mix_id"), F.col("th").alias("__mix_th")).agg(F.sum("copies").alias("__mix_n"), F.count("*").alias("__mix_c"))
    shares = shares.where("__mix_n > 0")
    key = F.col(id_col).eqNullSafe(F.col("__mix_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__mix_th"))
    rows = meet(docs, shares, key)
    alone = rows.where("__mix_c = 1").withColumn("__mix_k", F.explode(F.array_repeat(F.lit(0), F.col("__mix_n").cast("int"))))
    alike = rows.where("__mix_c > 1").dropDuplicates(by).withColumn("__mix_k", F.explode(F.array_repeat(F.lit(0), F.col("__mix_n").cast("int"))))
    return alone.unionByName(alike).drop(*by, "__mix_n", "__mix_c", "__mix_k")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS room FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share
  FROM r WINDOW w AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (SELECT share FROM f WHERE share <= room ORDER BY room, share LIMIT 1) AS level FROM f
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR room < level THEN cap ELSE level * weight END AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), j AS (
  SELECT d.doc_id, d.source, d.size, d.u, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         CASE WHEN p.source_size > 0 THEN (p.target - p.whole * p.source_size) / p.source_size ELSE 0 END AS part
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), k AS (
  SELECT *, CASE WHEN part > 0 AND size > 0
    THEN (((u + 0.5::DOUBLE) / 4503599627370496) / (1 - (u + 0.5::DOUBLE) / 4503599627370496)) / (part / (1 - part) * (1.0::DOUBLE + least(size, LONG) / LONG::DOUBLE)) END AS rank
  FROM j
), c AS (
  SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, u, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS till
  FROM k
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM (
  SELECT *, (whole + CASE WHEN rank IS NOT NULL AND till + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
""".replace("LONG", str(LONG))

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": ORACLE}
