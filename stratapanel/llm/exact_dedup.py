"""Exact dedup by deterministic block naming, in SQL functions only.

A text is cut into blocks of fixed size.  Equal blocks get one integer name, their
place when the distinct ones are sorted (by digest, and by content where digests
meet), so names depend on the texts only, not on how rows are dealt.  Then
adjacent pairs of names get names in the same way, level by level, until a single
name stands for the whole text.  Two texts have the same name at the same level
if and only if they are equal: each name stands for one content.

Block contents are shuffled once, after copies have met on the map side; all that
follows are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratapanel.llm.common import SPACE, cut, documents

#: Bytes of a block.
BLOCK = 1024


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with their place in sorted order as name: the same names however the rows are dealt.

    The keys are sorted into ranges, and a range's names start where those of the ranges before it end.
    """
    row = F.monotonically_increasing_id()  # range and row within it
    placed = cut(keys.sort(*by).select(*by, F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("row")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(*by, (F.col("start") + F.col("row")).alias("name"))


def identities(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name): equal (level, name) if and only if equal text."""

    def blocks(extra: list[Column]) -> DataFrame:
        text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
        whole = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.col("text").cast("binary").alias("bytes"), F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("rid"))
        n = F.greatest(F.ceil(F.length("bytes") / block), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(F.col("bytes"), (i * block + 1).cast("int"), F.lit(block)))
        return whole.select("rid", "doc_id", "sha", n.alias("n"), F.posexplode(parts).alias("i", "block")).select(*extra, digest("block").alias("h"), "block")

    seen = blocks([]).groupBy("h").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    seen = cut(seen.select("h", (F.col("low") != F.col("high")).alias("shared")))
    at = [F.col("rid"), F.col("i"), F.col("n"), F.when(F.col("i") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("i") == 0, F.col("sha")).alias("sha")]
    slim = ["rid", "i", "n", "doc_id", "sha", "h"]
    nodes = blocks(at)
    shared = seen.where("shared").select("h")
    if shared.isEmpty():
        names = _named(seen.select("h", F.lit(0).alias("sub")), ["h", "sub"])
        nodes = nodes.select(*slim, F.lit(0).alias("sub"))
    else:  # different blocks with one digest: told apart by content
        order = Window.partitionBy("h").orderBy("block")
        subs = cut(blocks([]).join(shared, "h", "left_semi").distinct().withColumn("sub", F.row_number().over(order)))
        names = _named(seen.where("not shared").select("h", F.lit(0).alias("sub")).union(subs.select("h", "sub")), ["h", "sub"])
        nodes = nodes.join(subs, ["h", "block"], "left").select(*slim, F.coalesce("sub", F.lit(0)).alias("sub"))
    nodes = cut(nodes.join(names, ["h", "sub"]).select("rid", "i", "n", "name", "doc_id", "sha"))
    heads = nodes.where("i = 0").select("rid", "doc_id", F.col("sha").alias("text_sha256"))
    done, level = None, 0
    rest = nodes.select("rid", "i", "n", "name")
    while True:
        ended = rest.where("n = 1").select("rid", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        rest = rest.where("n > 1")
        if rest.isEmpty():
            break
        even = F.col("i") % 2 == 0
        pairs = rest.groupBy("rid", F.shiftright("i", 1).alias("i")).agg(F.first("n").alias("n"), F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = cut(pairs.withColumn("n", F.shiftright(F.col("n") + 1, 1)))
        names = _named(pairs.groupBy("left", "right").agg(F.count("*").alias("c")).select("left", "right"), ["left", "right"])
        rest = cut(pairs.join(names, ["left", "right"]).select("rid", "i", "n", "name"))
        level += 1
    return heads.join(done, "rid")


def exact_dedup(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after runs of ASCII white space became one space; null
    counts as empty, so null and empty texts form one group.  The row with the
    smallest doc_id stays (a null id comes last); of rows alike in doc_id one
    stays.  An empty table gives an empty result; other columns of the input are
    not carried, whatever their names.  Blocks are cut in bytes, so that long
    texts cost no more for each byte than short ones.
    """
    ids = cut(identities(docs, block, id_col, text_col, digest))
    groups = ids.groupBy("level", "name").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"), F.count("*").alias("group_size"))
    groups = groups.select("level", "name", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size")
    joined = ids.join(groups, ["level", "name"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {"op6_exact_dedup": ORACLE}
