"""Packing into optimal length buckets.

Texts are cut into pieces of at most MAX_LENGTH words or tokens.  Dynamic programming over the
global histogram of piece lengths, which has a bounded number of bins, chooses the
bucket boundaries with the least padding.  Inside each bucket, pieces in a random
but fixed order fill batches up to a token budget, padding included.

Places within a bucket are counted by leading digits of the order key first, so that
a bucket with most of the rows is spread over all tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import WORD, cut, documents
from stratapanel.llm.token_counts import token_pieces

#: Words or tokens of a piece; buckets; words or tokens of a batch with its padding; hexadecimal digits of the order key.
MAX_LENGTH, BUCKETS, BUDGET, DIGITS = 2048, 8, 65_536, 3


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise total padding.

    ``lengths`` ascend.  Of equally good choices the one with the smaller bounds
    wins, seen from the last.  All arithmetic is exact.
    """
    n = len(lengths)
    if n == 0:
        return []
    size, count = np.array(lengths, np.int64), np.array(counts, np.int64)
    many = np.concatenate(([0], np.cumsum(count)))
    words = np.concatenate(([0], np.cumsum(count * size)))
    far = np.iinfo(np.int64).max // 4
    best, choice = np.full(n + 1, far), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, pick = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):  # lengths i..j-1 share the bucket bounded by lengths[j-1]
            cost = best[:j] + size[j - 1] * (many[j] - many[:j]) - (words[j] - words[:j])
            pick[j] = cost.argmin()
            new[j] = cost[pick[j]]
        best = new
        choice.append(pick)
    bounds, j = [], n
    for pick in reversed(choice):
        bounds.append(lengths[j - 1])
        j = int(pick[j])
    return bounds[::-1]


def word_pieces(docs: DataFrame, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parts of texts of at most ``max_length`` words: doc_id, piece, start_word, length.  Null and blank texts have one of length 0."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    last = F.greatest(F.ceil(F.col("words") / max_length), F.lit(1)) - 1
    pieces = sized.select("doc_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return pieces.select("doc_id", "piece", start.alias("start_word"), F.least(F.col("words") - start, F.lit(max_length)).alias("length"))


def fill(pieces: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, digits: int = DIGITS) -> DataFrame:
    """Batches of pieces (doc_id, piece, length, other columns): adds bucket, bucket_length, batch, slot, padding.

    ``length`` may be in words, tokens or any unit, the budget's; it has few different
    values, as pieces have a bound.  Pieces alike in id and number
    are ordered by length and a digest of their other columns, so that only equal ones are
    interchangeable.  ``batch`` counts from 0 within a bucket; its pieces times
    ``bucket_length`` stay within ``budget`` (a piece longer than the budget is a batch
    of its own).  An empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    keep = pieces.columns
    others = [F.col(f"`{c}`") for c in keep if c not in ("doc_id", "piece", "length")]
    pieces = cut(pieces.withColumn("__pack_key", key).withColumn("__pack_else", F.xxhash64(*others) if others else F.lit(0)))
    histogram = pieces.groupBy("length").count().orderBy("length").collect()  # a row for each length that a piece may have
    bounds = optimal_boundaries([r["length"] for r in histogram], [r["count"] for r in histogram], buckets)
    bucket, bound = F.lit(len(bounds) - 1), F.lit(bounds[-1] if bounds else 0)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("length") <= bounds[k], k).otherwise(bucket)
        bound = F.when(F.col("length") <= bounds[k], bounds[k]).otherwise(bound)
    placed = pieces.withColumns({"bucket": bucket.cast("int"), "bucket_length": bound.cast("long"), "__pack_digit": F.substring("__pack_key", 1, digits)})
    # Pieces before each digit of a bucket: at most buckets * 16 ** digits rows.
    run = Window.partitionBy("bucket").orderBy("__pack_digit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "__pack_digit").count().withColumn("__pack_before", F.coalesce(F.sum("count").over(run), F.lit(0))).drop("count")
    within = Window.partitionBy("bucket", "__pack_digit").orderBy("__pack_key", "doc_id", "piece", "length", "__pack_else")
    ranked = placed.withColumn("__pack_place", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["bucket", "__pack_digit"])
    place = F.col("__pack_before") + F.col("__pack_place")
    each = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))), F.lit(1))
    return ranked.select(
        *(f"`{c}`" for c in keep), "bucket", "bucket_length",
        F.floor(place / each).cast("long").alias("batch"), (place % each).cast("long").alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"),
    )


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, digits: int = DIGITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start_word, length, bucket, bucket_length, batch, slot, padding; lengths in words.

    Null, empty and blank texts are one piece of length 0.  Of a long text's pieces all
    but the last are full.  Repeated rows are packed each.  An empty table gives an
    empty result; other columns of the input are not carried, whatever their names.
    """
    return fill(word_pieces(docs, max_length, id_col, text_col), buckets, budget, digits)


def pack_tokens(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, digits: int = DIGITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with lengths and budget in tokens, and the text of each piece: doc_id, piece, start_char, length, text and the columns of ``fill``.

    So a batch can be built from its rows alone, and the pieces of a document give its
    text again.  ``tokenizer`` is the path of a byte-level tokenizers file.
    """
    return fill(token_pieces(docs, tokenizer, max_length, id_col, text_col), buckets, budget, digits)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def _oracle() -> str:
    """The same program in SQL: a table of best costs for each number of buckets."""
    steps = ["b0 AS (SELECT 0::BIGINT AS j, 0::HUGEINT AS cost, []::BIGINT[] AS bounds)"]
    for k in range(1, BUCKETS + 1):
        steps.append(f"""b{k} AS (
  SELECT j, m.cost AS cost, m.bounds AS bounds FROM (
    SELECT h.j, min({{'cost': b.cost + h.length * (h.many - i.many) - (h.words - i.words), 'i': b.j, 'bounds': list_append(b.bounds, h.length)}}) AS m
    FROM b{k - 1} b JOIN h i ON i.j = b.j JOIN h ON h.j > b.j GROUP BY h.j))""")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS words FROM documents
), e AS (
  SELECT doc_id, words, unnest(range(greatest(ceil(words / {MAX_LENGTH}.0), 1)::BIGINT)) AS piece FROM d
), p AS (
  SELECT doc_id, piece, piece * {MAX_LENGTH} AS start_word, least(words - piece * {MAX_LENGTH}, {MAX_LENGTH}) AS length,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || piece::VARCHAR) AS key FROM e
), c AS (
  SELECT length, count(*) AS n FROM p GROUP BY length
), h AS (
  SELECT row_number() OVER w AS j, length, (sum(n) OVER w)::HUGEINT AS many, (sum(n * length) OVER w)::HUGEINT AS words FROM c WINDOW w AS (ORDER BY length)
  UNION ALL SELECT 0, 0, 0, 0
), {", ".join(steps)}, bounds AS (
  SELECT unnest(bounds) AS bound, unnest(range({BUCKETS})) AS bucket FROM b{BUCKETS} WHERE j = (SELECT max(j) FROM h)
), q AS (
  SELECT p.*, bucket, bound FROM p ASOF JOIN bounds ON p.length <= bounds.bound
), r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id, piece, length) - 1 AS place, greatest({BUDGET} // greatest(bound, 1), 1) AS each FROM q
)
SELECT doc_id, piece, start_word, length, bucket::INTEGER AS bucket, bound::BIGINT AS bucket_length,
       (place // each)::BIGINT AS batch, (place % each)::BIGINT AS slot, bound - length AS padding
FROM r
"""


QUERIES = {"op7_packing": op7_packing}
ORACLES = {"op7_packing": _oracle()}
