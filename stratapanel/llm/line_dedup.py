"""Line dedup by a deletion-neighbourhood join, in SQL functions only.

Lines are compared as sequences of lower-case words.  A line goes if an earlier
line has the same words, or, for lines of NEAR_WORDS words or more, words at an edit
distance of one: one word replaced, inserted or deleted.  "Earlier" is by document
id, then line number, whether that line stays or not.  Lines of fewer than MIN_WORDS
words recur by chance, so they go only where they stand SHORT_TIMES times or more.

Two lines at distance one share a deletion variant: both without their word i, or
the longer one without a word and the shorter one whole.  All variants are emitted
as hashed keys, and each line of a key is compared with the earliest line of that
key, which is within the bound of all others.  The words of both are then compared.

One edit leaves the first or the last words of a line alone, nearly half of it.  So only
lines that share such an end with another line emit variants, and only of the rest.

All joins are shuffled, and texts meet keys in hash joins that don't sort them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import SPACE, WORD, cut, documents, meet

#: Words of a line that goes at its first repeat, and for the edit bound (4 or more).
MIN_WORDS, NEAR_WORDS = 4, 6
#: Places from which a line of fewer than MIN_WORDS words counts as repeated.
SHORT_TIMES = 10
#: How a line meets a key: without a word like another; without a word like a whole line; whole.
REPLACED, LONGER, SHORTER = 0, 1, 2


def _key(id_col: str, text_col: str) -> Column:
    """Stands for a row's id and text; joins on it compare the id as well."""
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def _single_spaced(line: Column) -> Column:
    """The line's words with one space between them; most lines are so already."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def _end(words: Column) -> Column:
    """So many words at either end one edit leaves alone in one of two lines of ``words`` words or one more.

    Lengths in steps of four, so that most lines share theirs with lines of one word more.
    """
    half = F.floor((words - 1) / 2).cast("int")
    return F.when(half < 4, half).otherwise(half - half % 4)


def _without(words: Column, i: Column) -> Column:
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))


def _line_keys(docs: DataFrame, near_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ih, line_no, n, k1, k2, ends) for each line that isn't blank: digests of its words, and of its ends."""
    lines = F.transform(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1), _single_spaced)
    # bytes that are spaces, counted without cutting the line up
    sized = F.transform(lines, lambda w: F.struct(w.alias("words"), F.when(w == "", 0).otherwise(F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit(""))) + 1).alias("n")))
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("ih"), F.posexplode(sized).alias("line_no", "line")).where("line.n > 0").select("doc_id", "ih", "line_no", "line.words", "line.n")
    rows = rows.withColumn("q", _end(F.col("n"))).withColumn("p", _end(F.col("n") - 1))  # p: against lines of a word less

    def ends(q: str) -> list[Column]:  # even digests stand for first words, odd ones for last words
        return [F.xxhash64(q, F.expr(f"substring_index(words, ' ', {q})")).bitwiseAND(F.lit(-2)), F.xxhash64(q, F.expr(f"substring_index(words, ' ', -{q})")).bitwiseOR(F.lit(1))]

    both = F.when(F.col("p") == F.col("q"), F.array(*ends("q"))).otherwise(F.array(*ends("q"), *ends("p")))
    return rows.select("doc_id", "ih", "line_no", "n", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(7), "words").alias("k2"), F.when(F.col("n") >= near_words, both).alias("ends"))


def _exact(slim: DataFrame, order: Column, min_words: int, short_times: int) -> DataFrame:
    """(doc_id, ih, line_no): all but the first place of repeated lines."""
    firsts = slim.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("c"), F.min("n").alias("words"))
    firsts = firsts.where((F.col("c") > 1) & ((F.col("words") >= min_words) | (F.col("c") >= short_times))).select("k1", "k2", "first")
    return slim.select("doc_id", "ih", "line_no", "k1", "k2").join(firsts, ["k1", "k2"]).where(order != F.col("first")).select("doc_id", "ih", "line_no")


def _likely(slim: DataFrame, order: Column) -> DataFrame:
    """(uid, tail_differs, head_differs, doc_id, ih, line_no): first places of lines that share an end with another; uid ascends by place."""
    parts = slim.where("ends is not null").select("doc_id", "ih", "line_no", "k1", "k2", F.explode("ends").alias("end"))
    shared = parts.groupBy("end").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("end")
    likely = parts.join(shared, "end").groupBy("k1", "k2").agg(F.min(order).alias("o"), F.max(F.col("end") % 2 == 0).alias("tail_differs"), F.max(F.col("end") % 2 != 0).alias("head_differs"))
    return likely.sort("o").select(F.monotonically_increasing_id().alias("uid"), "tail_differs", "head_differs", "o.doc_id", "o.ih", "o.line_no")


def _fetched(docs: DataFrame, likely: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``likely`` with the words of each line; rows alike in id and text give a line once."""
    wanted = likely.groupBy(F.col("ih").alias("wh"), F.col("doc_id").alias("w")).agg(F.collect_list(F.struct("uid", "tail_differs", "head_differs", "line_no")).alias("wants"))
    texts = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("ih"), F.col(text_col).alias("text"))
    found = meet(texts, wanted, (F.col("ih") == F.col("wh")) & F.col("doc_id").eqNullSafe(F.col("w")))
    lines = F.split(F.lower(F.coalesce("text", F.lit(""))), "\n", -1)
    each = F.transform("wants", lambda x: F.struct(x["uid"].alias("uid"), x["tail_differs"].alias("tail_differs"), x["head_differs"].alias("head_differs"), x["line_no"].alias("line_no"), _single_spaced(F.get("lines", x["line_no"])).alias("line")))
    rows = found.select("doc_id", "ih", "wants", lines.alias("lines")).select("doc_id", "ih", F.inline(each))
    return rows.dropDuplicates(["uid"]).withColumn("words", F.split("line", " ", -1)).drop("line")


def _variants(lines: DataFrame) -> DataFrame:
    """(uid, i, role, key): all deletion variants of each line.

    Their hashes take one pass over a line's words: the XOR of (word, place), where
    the words behind the deleted one move up by a place.
    """
    every = Window.partitionBy("uid")
    upto = every.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = every.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    i, least = F.col("i"), _end(F.col("n") - 1)
    # dealt out by uid before it is cut into words
    words = lines.select("uid", "tail_differs", "head_differs", "words").repartition("uid").select("uid", "tail_differs", "head_differs", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    words = words.select("uid", "n", "i", ((F.col("tail_differs") & (i >= least)) | (F.col("head_differs") & (i < F.col("n") - least))).alias("use"), F.xxhash64("word", "i").alias("here"), F.xxhash64("word", i - 1).alias("moved"))
    variants = words.select(
        "uid", "n", "i", "use",
        F.coalesce(F.bit_xor("here").over(before), F.lit(0)).bitwiseXOR(F.bit_xor("moved").over(upto)).bitwiseXOR(F.bit_xor("moved").over(every)).alias("gone"),
        F.bit_xor("here").over(every).alias("whole"),
    )
    row = lambda role, key: F.struct(F.lit(role).cast("byte").alias("role"), key.alias("key"))
    replaced = F.when(F.col("use"), row(REPLACED, F.xxhash64(F.lit(0), "gone", "i", "n")))
    longer = F.when(F.col("use"), row(LONGER, F.xxhash64(F.lit(1), "gone", F.col("n") - 1)))
    shorter = F.when(i == 0, row(SHORTER, F.xxhash64(F.lit(1), "whole", "n")))
    return variants.select("uid", "i", F.explode(F.array_compact(F.array(replaced, longer, shorter))).alias("v")).select("uid", "i", "v.*")


def _close(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ih, line_no): lines within the edit bound of an earlier one."""
    role = F.col("role")
    least = lambda r, name: [F.min(F.when(role == r, F.col("uid"))).alias(name), F.min_by("i", F.when(role == r, F.col("uid"))).alias(f"{name}_i")]
    groups = keyed.groupBy("key").agg(*least(REPLACED, "replaced"), *least(LONGER, "longer"), *least(SHORTER, "shorter"), F.count_if(role == REPLACED).alias("c"))
    groups = groups.where("c > 1 or (longer is not null and shorter is not null)").drop("c")
    other = lambda tail: F.when(role == REPLACED, F.col(f"replaced{tail}")).when(role == LONGER, F.col(f"shorter{tail}")).otherwise(F.col(f"longer{tail}"))
    pairs = keyed.join(groups, "key").select("role", F.col("uid").alias("a"), F.col("i").alias("ai"), other("").alias("b"), other("_i").alias("bi")).where("b < a")
    mine = lines.select(F.col("uid").alias("a"), F.col("words").alias("mine"), "doc_id", "ih", "line_no")
    theirs = lines.select(F.col("uid").alias("b"), F.col("words").alias("theirs"))
    pairs = pairs.join(mine, "a").join(theirs, "b")
    cut_mine = F.when(role == SHORTER, F.col("mine")).otherwise(_without(F.col("mine"), F.col("ai")))
    cut_theirs = F.when(role == LONGER, F.col("theirs")).otherwise(_without(F.col("theirs"), F.col("bi")))
    return pairs.where(cut_mine == cut_theirs).select("doc_id", "ih", "line_no").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, short_times: int = SHORT_TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ih, line_no, is_near): the lines that go; is_near if no earlier line has the same words."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ih", "line_no")
    slim = cut(_line_keys(docs, near_words, id_col, text_col))
    same = cut(_exact(slim, order, min_words, short_times))
    likely = cut(_likely(slim, order))
    lines = cut(_fetched(docs, likely, id_col, text_col))
    close = cut(_close(cut(_variants(lines)), lines))
    return same.withColumn("is_near", F.lit(False)).unionByName(close.withColumn("is_near", F.lit(True)))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, short_times: int = SHORT_TIMES, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str, str] = ("n_lines", "n_removed", "n_near")) -> DataFrame:
    """The rows of ``docs``, all columns kept, with the text of the lines that stay; adds n_lines, n_removed, n_near.

    Null counts as an empty text and stays null.  Blank lines stay.  Of equal first
    lines within one document the one above stays; rows alike in id and text are one
    document here, and keep the same lines.  Null ids come last.  An empty table gives
    an empty result.  ``counts`` names the three added columns; where ``docs`` has
    such a column, that one stays and the added one is called lines_<name>.
    """
    taken = {c.lower() for c in docs.columns}
    counts = tuple(f"lines_{c}" if c.lower() in taken else c for c in counts)
    going = repeated_lines(docs, min_words, near_words, short_times, id_col, text_col)
    going = going.groupBy(F.col("ih").alias("__lines_ih"), F.col("doc_id").alias("__lines_id")).agg(F.collect_set("line_no").alias("__lines_going"), F.countDistinct(F.when(F.col("is_near"), F.col("line_no"))).alias("__lines_near"))
    joined = meet(docs.withColumn("__lines_key", _key(id_col, text_col)), going, (F.col("__lines_key") == F.col("__lines_ih")) & F.col(id_col).eqNullSafe(F.col("__lines_id")), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__lines_going")
    kept = F.when(F.col("__lines_going").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stays, lambda at: F.get(lines, at)), "\n"))
    n_lines = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")) + 1
    counted = joined.withColumns(dict(zip(counts, (n_lines.cast("long"), F.coalesce(F.size("__lines_going"), F.lit(0)).cast("long"), F.coalesce("__lines_near", F.lit(0)).cast("long")))))
    return counted.withColumn(text_col, kept).drop("__lines_key", "__lines_ih", "__lines_id", "__lines_going", "__lines_near")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM s
), w AS (
  SELECT doc_id, line_no, regexp_extract_all(lower(line), '{WORD}') AS w FROM l
), e AS (
  SELECT doc_id, line_no, w, len(w) AS n, array_to_string(w, ' ') AS k,
         row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, line_no) AS turn,
         count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS times
  FROM w WHERE len(w) > 0
), f AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS o FROM e WHERE turn = 1 AND n >= {NEAR_WORDS}
), v AS (
  SELECT o, n, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS g FROM (SELECT *, unnest(range(n)) AS i FROM f)
), near AS (
  SELECT a.o FROM v a JOIN v b ON a.g = b.g AND a.i = b.i AND a.n = b.n AND b.o < a.o
  UNION SELECT a.o FROM v a JOIN f b ON a.g = b.k AND b.o < a.o
  UNION SELECT b.o FROM v a JOIN f b ON a.g = b.k AND a.o < b.o
), gone AS (
  SELECT doc_id, line_no, false AS is_near FROM e WHERE turn > 1 AND (n >= {MIN_WORDS} OR times >= {SHORT_TIMES})
  UNION ALL SELECT doc_id, line_no, true FROM f SEMI JOIN near USING (o)
), j AS (
  SELECT l.*, g.is_near FROM l LEFT JOIN gone g USING (doc_id, line_no)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(is_near)::BIGINT AS n_removed, count(*) FILTER (is_near)::BIGINT AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (is_near IS NULL), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": ORACLE}
