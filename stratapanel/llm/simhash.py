"""SimHash near-dedup with BK-trees.

Texts with one fingerprint are one node.  Two fingerprints within RADIUS bits
agree in at least BANDS - RADIUS of BANDS bands of bits, so each node goes to the shards
of all such sets of bands, where a BK-tree is built: children are keyed by their Hamming
distance to the parent, and a query follows only edges within the radius of its
own distance.  A shard of more than TREE nodes is dealt into blocks, and each pair
of blocks is a task of its own: a tree from the one, queries from the other.  Trees
travel to their queries in the shuffle; sent to all, they would grow with the data.

All links of a tree are followed, but a task reports a spanning forest of them
only; the forests are joined by alternating star contractions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import cut, doc_key, documents, meet

#: Differing bits of a link; bands (64 bits as evenly as may be); nodes of a tree.
#: A shard's key has some 27 bits, so that chance meetings stay few up to billions of nodes.
RADIUS, BANDS, TREE = 4, 7, 1024
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """64 majority bits over the XXH64 (seed 42) of all word shingles; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    size, line = min(words, len(tokens)), b" ".join(tokens)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    stop = (start + length)[size - 1 :]
    ones, total, digest = np.zeros(64, np.int64), len(stop), xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        spans = zip(start[at : at + CHUNK].tolist(), stop[at : at + CHUNK].tolist())
        h = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, min(CHUNK, total - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp long) for each row; th is a digest of the text."""
    picked = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "text")

    def make(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(fp)], [*(batch.schema.names[i] for i in rest), "fp"])

    return picked.mapInArrow(make, schema + ", fp long")


def tree_links(group: np.ndarray, fp: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` in each group, found by one BK-tree for each group.

    Rows with asks < 2 are in the tree, rows with asks > 0 query it.  All trees grow
    together, level by level.  Returns row numbers (query, node).
    """
    rows = np.flatnonzero(asks < 2)
    first = rows[np.unique(group[rows], return_index=True)[1]]  # the roots
    root = dict(zip(group[first].tolist(), first.tolist()))
    pending = np.setdiff1d(rows, first, assume_unique=True)
    at = np.array([root[g] for g in group[pending].tolist()], np.int64)
    edges: list[np.ndarray] = []
    while len(pending):
        far = np.bitwise_count(fp[pending] ^ fp[at]).astype(np.int64)
        place = at * 65 + far
        _, head, back = np.unique(place, return_index=True, return_inverse=True)
        child = pending[head]
        edges.append(np.stack((place[head], child)))
        at = child[back]
        on = np.ones(len(pending), bool)
        on[head] = False
        pending, at = pending[on], at[on]
    place, child = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    order = np.argsort(place, kind="stable")
    place, child = place[order], child[order]
    ask = np.flatnonzero(asks > 0)
    ask = ask[np.isin(group[ask], group[first])]
    node = np.array([root[g] for g in group[ask].tolist()], np.int64)
    found: list[np.ndarray] = []
    while len(ask):
        far = np.bitwise_count(fp[ask] ^ fp[node]).astype(np.int64)
        hit = far <= radius
        found.append(np.stack((ask[hit], node[hit])))
        low = np.searchsorted(place, node * 65 + np.maximum(far - radius, 0))
        high = np.searchsorted(place, node * 65 + np.minimum(far + radius, 64), side="right")
        n = high - low
        ask = np.repeat(ask, n)
        node = child[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else child[:0]
    out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return out[0], out[1]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the links (a, b) connect."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(ids))
    return ids[off], ids[label[off]]


def links(nodes: DataFrame, radius: int = RADIUS, bands: int = BANDS, tree: int = TREE) -> DataFrame:
    """(a, b): enough links within ``radius`` bits between distinct ``fp`` to connect all that are linked."""
    alike = bands - radius
    if alike < 1:
        raise ValueError("more bands than radius are needed")
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(bands), alike)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))
    placed = nodes.select("fp", F.explode(keys).alias("key"))
    shards = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = placed.join(shards, "key").withColumn("blocks", F.ceil(F.col("n") / tree).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A block meets itself (0: tree and query), later blocks as tree (1 -> -1) and earlier ones as query.
    turns = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), F.when(other == F.col("mine"), 1).when(other > F.col("mine"), 0).otherwise(2).cast("byte").alias("asks")))
    tasks = members.withColumn("mine", mine).select("fp", "key", F.explode(turns).alias("turn")).select("fp", F.xxhash64("key", "turn.i", "turn.j").alias("task"), "turn.asks")

    def find(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def emit(last: bool):
            nonlocal held, rows
            table = pa.Table.from_batches(held)
            task, fp, asks = (table.column(c).to_numpy() for c in ("task", "fp", "asks"))
            end = len(task) if last else int(np.searchsorted(task, task[-1]))  # rows come sorted by task
            held, rows = (table.slice(end).to_batches(), len(task) - end) if end < len(task) else ([], 0)
            bits = fp[:end].astype(np.int64).view(np.uint64)
            a, b = tree_links(task[:end], bits, asks[:end], radius)
            a, b = fp[a], fp[b]
            a, b = forest(a[a != b], b[a != b])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * tree:
                yield emit(False)
        if held:
            yield emit(True)

    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(find, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Large and small stars in turn until nothing changes; each round is written to
    the checkpoint folder.  A star of any size is a join on its centre, which
    Spark can split, and an aggregate with map-side combining.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()
        edges = cut(small.where("a <> b"))
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, th (digest of the text), fp long, component, component_id.

    ``component_id`` is the smallest doc_id that links of at most ``radius`` bits
    reach, itself included.  Null, empty and blank texts have fingerprint zero and
    are linked like any other; repeated rows share a component.  Null ids count as
    the largest.  An empty table gives an empty result; other columns of the input
    are not carried, whatever their names.
    """
    marked = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = components(links(nodes.select("fp"), radius, bands)).withColumnRenamed("node", "fp")
    whole = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = whole.select("fp", "component").join(named, "component").select("fp", "component", "component_id")
    return marked.join(classes, "fp").select("doc_id", "th", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = RADIUS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that come first in their component.

    First is the smallest id (null last), then text digest; of rows alike in both one stays.
    """
    return _first_of_each(docs, cut(near_duplicates(docs, words, radius, bands, id_col, text_col)), id_col, text_col)


def _first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("f"))
    first = first.select("component", F.col("f.doc_id").alias("__near_id"), F.col("f.th").alias("__near_th"))
    again = found.groupBy("doc_id", "th").agg(F.count("*").alias("__near_c")).where("__near_c > 1").select(F.col("doc_id").alias("i"), F.col("th").alias("h"), F.lit(True).alias("__near_again"))
    first = first.join(again, F.col("__near_id").eqNullSafe(F.col("i")) & (F.col("__near_th") == F.col("h")), "left").select("__near_id", "__near_th", "__near_again")
    rows = meet(docs, first, F.col(id_col).eqNullSafe(F.col("__near_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__near_th")))
    alike = rows.where("__near_again").dropDuplicates(["__near_id", "__near_th"])
    return rows.where("__near_again is null").unionByName(alike).drop("__near_id", "__near_th", "__near_again")


#: Near copies by similarity: fingerprints of a text; bands of each, of which a shard takes two (some 26 bits); bits of
#: all fingerprints that a pair to be verified may differ in (a pair at 0.8 differs in about 15 %, unrelated texts in
#: half); nodes of a block.  Two bands of few, over more fingerprints, find as much with half the keys of three of seven.
SEEDS, PARTS, REACH, BLOCK = 20, 5, 0.25, 256
#: Nodes whose keys one task writes; shingles that count as a row of a block, so that long texts make more blocks.
DEALT, ROW_SHINGLES = 1 << 13, 1 << 12


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of all word shingles; nothing without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size, line = min(words, len(tokens)), b" ".join(tokens)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    stop = (start + length)[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(stop)))


def seeded(found: np.ndarray, seeds: int) -> np.ndarray:
    """A SimHash of a set of shingles for each seed."""
    out = np.zeros(seeds, np.uint64)
    for k in range(seeds if len(found) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), CHUNK):
            h = found[at : at + CHUNK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(found), bitorder="little").view(np.uint64)[0]
    return out


def sketches(docs: DataFrame, words: int, seeds: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, sh, size, fps) for each row; sh is a digest of its set of shingles, size their number, fps its fingerprints."""
    picked = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "text")

    def make(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            sh = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            fps = pa.array([seeded(x, seeds).view(np.int64) for x in sets], pa.list_(pa.int64()))
            size = pa.array([len(x) for x in sets], pa.int64())
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(sh), size, fps], [*(batch.schema.names[i] for i in rest), "sh", "size", "fps"])

    return picked.mapInArrow(make, schema + ", sh long, size long, fps array<long>")


def _by_task(batches, least: int):
    """Tables of whole tasks, of ``least`` rows or more but for the last; rows come sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            table = pa.Table.from_batches(held)
            task = table.column("task").to_numpy()
            end = int(np.searchsorted(task, task[-1]))
            held = table.slice(end).to_batches()
            if end:
                yield table.slice(0, end)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(members: DataFrame, block: int, *keep: str) -> DataFrame:
    """(task, asks, sh, keep): rows of each (key, n) dealt into pairs of blocks, sorted by task."""
    members = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("sh"), F.col("blocks")).cast("int"))
    turns = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), F.when(other == F.col("mine"), 1).when(other > F.col("mine"), 0).otherwise(2).cast("byte").alias("asks")))
    tasks = members.select("sh", *keep, "key", F.explode(turns).alias("turn")).select(F.xxhash64("key", "turn.i", "turn.j").alias("task"), "turn.asks", "sh", *keep)
    return tasks.repartition("task").sortWithinPartitions("task")


def candidates(nodes: DataFrame, seeds: int, tree: int = TREE) -> DataFrame:
    """(a, b): links that connect all nodes (sh, fps) which share a shard of any seed and differ in few bits of all fingerprints.

    A shard's key holds the seed in its last bits.  Each node has many keys, so nodes,
    which should be materialised, are dealt to as many tasks as their number asks for.
    """
    cuts = [round(64 * i / PARTS) for i in range(PARTS + 1)]
    chosen = np.array([sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in c) for c in combinations(range(PARTS), 2)], np.uint64)
    signed = chosen.view(np.int64).tolist()
    dealt = nodes.select("sh", "fps").repartition(max(1, -(-nodes.count() // DEALT)), "sh")
    each = dealt.select("sh", F.posexplode("fps").alias("seed", "fp"))
    last = (1 << max(1, (seeds - 1).bit_length())) - 1
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("seed"), F.col("fp").bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(F.lit(~last)).bitwiseOR(F.col("seed")) for i, m in enumerate(signed)))
    placed = each.select("sh", F.explode(keys).alias("key"))
    shards = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    slim = placed.join(shards, "key").withColumn("seed", F.col("key").bitwiseAND(F.lit(last)).cast("int"))
    most = int(64 * seeds * REACH)

    def find(batches):
        for table in _by_task(batches, 16 * tree):
            task, asks, sh, seed = (table.column(c).to_numpy() for c in ("task", "asks", "sh", "seed"))
            bits = table.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, seeds)
            a, b = tree_links(task, bits[np.arange(len(task)), seed], asks, 16)
            far = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            on = (far <= most) & (sh[a] != sh[b])
            a, b = forest(sh[a[on]], sh[b[on]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _blocks(slim.join(nodes.select("sh", "fps"), "sh"), tree, "seed", "fps").mapInArrow(find, "a long, b long")


def verified(members: DataFrame, words: int, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all pairs of rows (key, n, sh, text) of one key whose shingle sets have a Jaccard similarity of ``least``.

    ``n`` is the number of a key's rows, or more where their texts are long: the rows
    are dealt into n / ``block`` blocks, and a task takes two.
    """

    def find(batches):
        for table in _by_task(batches, 1):
            task, asks, sh = (table.column(c).to_numpy() for c in ("task", "asks", "sh"))
            texts = table.column("text")
            a: list[int] = []
            b: list[int] = []
            for rows in np.split(np.arange(len(task)), np.flatnonzero(np.diff(task)) + 1):
                sets = [set(shingles(texts[int(i)].as_py(), words).tolist()) for i in rows]
                label = list(range(len(rows)))
                groups = [[k] for k in label]
                for x in np.flatnonzero(asks[rows] > 0).tolist():
                    for y in np.flatnonzero(asks[rows] < 2).tolist():
                        small, large = sorted((len(sets[x]), len(sets[y])))
                        if label[x] == label[y] or small < least * large:
                            continue
                        both = len(sets[x] & sets[y])
                        if both >= least * (small + large - both):
                            old, new = sorted((label[x], label[y]), key=lambda k: len(groups[k]))
                            for k in groups[old]:
                                label[k] = new
                            groups[new] += groups[old]
                            a.append(sh[rows[x]])
                            b.append(sh[rows[y]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _blocks(members, block, "text").mapInArrow(find, "a long, b long")


def similar(docs: DataFrame, words: int, least: float, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, th (digest of the text), component.

    Texts with equal sets of shingles are linked, and candidates of any seed whose sets
    have a Jaccard similarity of ``least``.  No pair below it is linked directly.
    """
    marked = cut(sketches(docs, words, seeds, id_col, text_col))
    nodes = cut(marked.groupBy("sh").agg(F.min("fps").alias("fps"), F.min("size").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("f")))
    loose = cut(components(candidates(nodes, seeds)).withColumnsRenamed({"node": "sh", "component": "key"}))
    found = loose.join(nodes.drop("fps"), "sh")
    sizes = found.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / ROW_SHINGLES)).alias("n"))
    first = cut(found.join(sizes, "key").select("sh", "key", "n", F.col("f.doc_id").alias("i"), F.col("f.th").alias("h")))
    texts = docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text"))
    members = meet(texts, first, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("sh", "key", "n", "text").dropDuplicates(["sh"])
    pairs = cut(verified(members, words, least))
    parts = components(pairs).withColumnRenamed("node", "sh")
    return marked.join(parts, "sh", "left").select("doc_id", "th", F.coalesce("component", "sh").alias("component"))


def one_of_similar(docs: DataFrame, words: int = 5, least: float = 0.8, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that come first in their component of ``similar``.

    First is the smallest id (null last), then text digest; of rows alike in both one stays.
    """
    found = cut(similar(docs, words, least, seeds, id_col, text_col))
    return _first_of_each(docs, found, id_col, text_col)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
