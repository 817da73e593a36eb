"""MinHash near-dedup by one-permutation hashing.

The hashes of a text's shingles are cut into bins by their high bits, and each bin keeps
its smallest.  Optimal densification fills an empty bin from the first filled one in the
bin's own random order.  Rows of bins make the keys of banded buckets.  A bucket proposes
a star, one edge from its centre to each other member, so that pairs grow with members
and not with their square.  Edges are confirmed on full sets of shingles.

A star can miss links between two rays of which one isn't linked to the centre.  Only
those rays are compared with the rest of their bucket, by an index over blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import cut, doc_key, documents, meet
from stratapanel.llm.simhash import _by_task, components, forest, shingles

#: Bands and bins of a band.  A pair at a similarity of 0.8 shares no bucket once in some 300,000 times.
BANDS, ROWS = 32, 5
#: Rays of a star that share one copy of its centre's set; shingles of a block of rays.
RAYS, BLOCK_SHINGLES = 4_096, 1 << 18
#: Sizes of linked sets differ by this factor at most, so that they lie in one class of sizes or in two that adjoin.
_CLASS = math.log(1.25)

_BINS = BANDS * ROWS
_EDGES = np.array([-(-(k << 64) // _BINS) for k in range(_BINS)], np.uint64)
_ORDER = np.random.default_rng(13).permuted(np.tile(np.arange(_BINS, dtype=np.uint8), (_BINS, 1)), axis=1)


def sketch(ids: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of sorted distinct hashes; empty bins take that of the filled bin which comes first in their order."""
    at = np.searchsorted(ids, _EDGES)
    full = at < np.append(at[1:], len(ids))
    out = ids[np.minimum(at, len(ids) - 1)]
    if not full.all():
        filled, empty = np.flatnonzero(full), np.flatnonzero(~full)
        out[empty] = out[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def bucket_keys(ids: np.ndarray) -> np.ndarray:
    """A key for each band."""
    rows = sketch(ids).reshape(BANDS, ROWS)
    key = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, sh, size, keys) for each row: digests of text and set (null without words), shingles, and bucket keys.

    Sets of fewer than four have no keys: they reach a similarity of 0.8 with equal sets only.
    """
    picked = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))

    def make(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            sh = pa.array([int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64)) if len(x) else None for x in sets], pa.int64())
            keys = pa.array([bucket_keys(x) if len(x) > 3 else x[:0].view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), sh, pa.array([len(x) for x in sets], pa.int64()), keys], ["doc_id", "th", "sh", "size", "keys"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(make, f"doc_id {kind}, th long, sh long, size long, keys array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sh, ids): the sorted shingle hashes of each row of ``nodes`` (sh, i, h), made again from the text of row (i, h)."""
    texts = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    rows = meet(texts, nodes, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("sh", "text").dropDuplicates(["sh"])

    def make(batches):
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sh"), pa.array(sets, pa.list_(pa.int64()))], ["sh", "ids"])

    return rows.mapInArrow(make, "sh long, ids array<long>")


def stars(members: DataFrame) -> DataFrame:
    """(key, centre, centre_size, sh, size, n): the rays of each bucket of ``members`` (key, n, sh, size).

    The centre is the member whose buckets are largest together: an original meets more of
    its copies than these meet each other.
    """
    met = members.groupBy("sh").agg(F.sum("n").alias("met"))
    centre = members.join(met, "sh").groupBy("key").agg(F.max(F.struct("met", "sh", "size")).alias("c"))
    rays = members.join(centre, "key").where(F.col("sh") != F.col("c.sh"))
    return rays.select("key", F.col("c.sh").alias("centre"), F.col("c.size").alias("centre_size"), "sh", "size", "n")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (centre, sh) whose full sets share ``percent`` of their union.

    A star of many rays is dealt out in parts, each with a copy of the centre's set.
    """
    degrees = edges.groupBy("centre").agg(F.ceil(F.count("*") / RAYS).alias("parts"))
    dealt = edges.join(degrees, "centre").withColumn("part", F.pmod(F.xxhash64("sh"), F.col("parts"))).drop("parts")
    copies = degrees.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    centres = copies.join(sets.withColumnsRenamed({"sh": "centre", "ids": "centre_ids"}), "centre")
    tests = dealt.join(centres, ["centre", "part"]).join(sets, "sh")
    both = F.size(F.array_intersect("centre_ids", "ids"))
    return tests.where(100 * both >= percent * (F.size("centre_ids") + F.size("ids") - both)).select("centre", "sh")


def missed(rays: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all pairs of rays of one bucket that are linked, though one of them isn't to the centre.

    Rays without a link to the centre are compared with all rays of their bucket, in blocks
    of rays; buckets of the same rays are compared once.
    """
    tried = rays.join(links.withColumn("ok", F.lit(True)), ["centre", "sh"], "left").select("key", "sh", "size", F.col("ok").isNull().alias("off"))
    of = tried.groupBy("key").agg(F.count("*").alias("n"), F.count_if("off").alias("f"), F.bit_xor(F.xxhash64("sh", "off")).alias("x"), F.sum(F.xxhash64("off", "sh").bitwiseAND(0xFFFFFFFF)).alias("y"))
    once = of.where("f > 0 and n > 1").groupBy("n", "f", "x", "y").agg(F.min("key").alias("key")).select("key")
    size_class = F.floor(F.log(F.col("size").cast("double")) / _CLASS).cast("int")
    rest = tried.join(once, "key").withColumn("c", F.explode(F.array(size_class, size_class - 1)))
    block = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(BLOCK_SHINGLES / F.pow(F.lit(1.25), F.col("c") + 2))))
    groups = rest.groupBy("key", "c").agg(F.count("*").alias("n"), F.count_if("off").alias("f")).where("f > 0 and n > 1")
    groups = groups.select("key", "c", F.ceil(F.col("n") / block).alias("all"), F.ceil(F.col("f") / block).alias("offs"))
    dealt = rest.join(groups, ["key", "c"]).withColumn("i", F.pmod(F.xxhash64("sh"), F.col("offs"))).withColumn("j", F.pmod(F.xxhash64("sh", "c"), F.col("all")))
    zero = F.lit(0).cast("long")
    kept = dealt.select("key", "c", "sh", F.explode(F.sequence(zero, F.col("offs") - 1)).alias("i"), "j", F.lit(False).alias("asks"))
    asked = dealt.where("off").select("key", "c", "sh", "i", F.explode(F.sequence(zero, F.col("all") - 1)).alias("j"), F.lit(True).alias("asks"))
    tasks = cut(kept.unionByName(asked).select(F.xxhash64("key", "c", "i", "j").alias("task"), "asks", "sh"))

    def find(batches):
        for table in _by_task(batches, 1):
            task, sh = table.column("task").to_numpy(), table.column("sh").to_numpy()
            asks = table.column("asks").to_numpy()
            ids = table.column("ids").combine_chunks()
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            size = np.diff(ends)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for rows in np.split(np.arange(len(task)), np.flatnonzero(np.diff(task)) + 1):
                held, asking = rows[~asks[rows]], rows[asks[rows]]
                if not len(held) or not len(asking):
                    continue
                ids_of = np.concatenate([flat[ends[r] : ends[r + 1]] for r in held])
                order = np.argsort(ids_of, kind="stable")
                ids_of, owner = ids_of[order], np.repeat(np.arange(len(held)), size[held])[order]
                for q in asking:
                    mine = flat[ends[q] : ends[q + 1]]
                    low, high = np.searchsorted(ids_of, mine), np.searchsorted(ids_of, mine, side="right")
                    n = high - low
                    hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[hits], minlength=len(held))
                    to = held[(100 * both >= percent * (size[q] + size[held] - both)) & (sh[held] != sh[q])]
                    out.append((np.full(len(to), sh[q]), sh[to]))
            a, b = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tasks.join(sets, "sh").select("task", "asks", "sh", "ids").repartition("task").sortWithinPartitions("task").mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, th (digest of the text), n_shingles, component_id, kept.

    Rows are linked whose sets of word shingles share ``percent`` of their union; ``component_id``
    is the smallest doc_id that links reach, itself included, and ``kept`` whether that
    is the row's own.  Rows without words (null, empty and blank texts too) are linked with
    nothing.  Repeated rows share a component, and each of them is kept if one is.  Null
    ids count as the largest; a component of null ids alone has a null ``component_id``
    and is kept.  An empty table gives an empty result; other columns aren't carried,
    whatever their names.

    Sets are told apart by 64-bit digests and compared as sets of 64-bit shingle hashes.
    Bands and classes of sizes are made for 80 percent or more; less is refused.
    """
    if percent < 80:
        raise ValueError("the bands find pairs of 80 percent or more")
    marked = cut(sketches(docs, words, id_col, text_col))
    nodes = cut(marked.where("sh is not null").groupBy("sh").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("f")))
    placed = nodes.select("sh", "size", F.explode("keys").alias("key"))
    members = cut(placed.join(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    rays = cut(stars(members))
    edges = rays.where(100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")).select("centre", "sh").distinct()
    met = members.select("sh").distinct().join(nodes, "sh").select("sh", F.col("f.doc_id").alias("i"), F.col("f.th").alias("h"))
    sets = cut(full_sets(docs, met, words, id_col, text_col))
    links = cut(confirmed(edges, sets, percent))
    parts = components(links.select(F.col("centre").alias("a"), F.col("sh").alias("b")).unionByName(missed(rays, links, sets, percent))).withColumnRenamed("node", "sh")
    whole = nodes.select("sh", "low").join(parts, "sh", "left").withColumn("component", F.coalesce("component", "sh"))
    named = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = whole.select("sh", "component").join(named, "component").select("sh", "component_id")
    out = marked.drop("keys").join(classes, "sh", "left").withColumn("component_id", F.when(F.col("sh").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "th", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4).drop("th")


QUERIES = {"op13_minhash": op13_minhash}
ORACLES: dict[str, str] = {}
