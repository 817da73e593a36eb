"""Removing repeated byte strings with longest-previous-factor arrays.

Only text near a repeated anchor can hold a repeated string.  The anchor of a
window of MIN_BYTES bytes is the least hash among its GRAM-byte strings; successive
windows with one anchor form a run, the same in every copy of the text around it.

1. Runs are grouped by anchor.  A group of one run has no copies, unless the anchor
   stands in it twice.  If all runs of a group are equal, all their windows are
   repeated.  A run has RUN windows at most, so that a text of any period is met in parts.
2. Of the other groups, one run of each content is kept.  Their windows are put in
   suffix order; the previous and the next smaller position in that order give each
   window's longest previous factor.  If it has the full length, the window is a
   later copy of the earlier one found.
3. A group with more than GROUP different runs (some 1 MB) isn't given to one task.  The text after
   the anchors, and the reversed text before them, are sorted over all tasks; what a
   run shares with its neighbours in the two orders bounds the windows that can be
   repeated.  Runs cut to these bounds mostly are equal, as in 1.  Those that aren't
   are cut into blocks of 64 windows, then 8, then 1, aligned at the anchor.  Blocks
   meet by content, where the least position is the earlier copy, and one block of
   each content is cut on.

Texts travel compressed, and only by key: to cut out the runs of step 2, and to
remove the spans found.

Passages are found in the same way, with words in place of bytes: a text becomes the
string of its words' hashes, and all lengths and positions count words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import cut, doc_key, documents

#: Bytes of a repeated string; of an anchor (a power of two).
MIN_BYTES, GRAM = 400, 64
#: Words of a repeated passage (over 50); of its anchor (a power of two).
PASSAGE, WORD_GRAM = 51, 8
#: Different runs of a group for one task; bytes of text in one suffix order; windows hashed at a time; most windows of a run.
GROUP, BLOCK, SEGMENT, RUN = 1024, 1 << 20, 1 << 17, 1024
#: Windows of the blocks that the runs of larger groups are cut into.
WIDTHS = (64, 8, 1)
#: A length that bounds nothing.
NO_BOUND = 1 << 30

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
#: What the bytes of a unit of text are read as: a byte, or a word's hash.
_KIND = {1: np.uint8, 4: np.uint32}


def word_hashes(data: bytes) -> bytes:
    """A hash of 4 bytes for each word (what stands between white space)."""
    if not _POWERS:  # of the base and of its inverse; made by each worker
        for step in (_BASE, pow(_BASE, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(SEGMENT, step, np.uint64)]))
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        part = raw[at : at + SEGMENT]
        space = _SPACE[part]
        if len(part) == SEGMENT:  # ends at white space
            last = len(part) - int(space[::-1].argmax()) if space.any() else 0
            if not last:  # a word longer than a segment
                gaps = np.flatnonzero(_SPACE[raw[at:]])
                last = int(gaps[0]) if len(gaps) else len(raw) - at
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at : at + last]) >> 32], np.uint32))
                at += last
                continue
            part, space = part[:last], space[:last]
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True)).reshape(-1, 2)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * _POWERS[0][: len(part)])))
        h = (sums[edges[:, 1]] - sums[edges[:, 0]]) * _POWERS[1][edges[:, 0]]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(32)).astype(np.uint32))
        at += len(part)
    return np.concatenate(out).tobytes() if out else b""


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def _anchors(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of GRAM bytes (WORD_GRAM words), and the anchor of each window of ``size`` of them."""
    h, span = (_TABLE[data], 1) if data.itemsize == 1 else (data * np.uint64(_BASE), 1)
    gram = _gram(data.itemsize)
    while span < gram:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
        span *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h, _least(h, size - gram + 1)


def _gram(unit: int) -> int:
    return GRAM if unit == 1 else WORD_GRAM


def runs(data: bytes, size: int = MIN_BYTES, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and anchors of the runs of a text; whether an anchor may stand there twice.

    Only a run with its anchor in two places can repeat a window within itself.
    """
    n = len(data) // unit - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    raw, starts, values, twice = np.frombuffer(data, _KIND[unit]), [], [], []
    for at in range(0, n, SEGMENT):
        h, m = _anchors(raw[at : min(at + SEGMENT, n) + size - 1], size)
        new = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
        ends = np.concatenate((new[1:], [len(m)])) + (size - _gram(unit))
        starts.append(new + at)
        values.append(m[new])
        twice.append(np.array([np.count_nonzero(h[a:b] == v) > 1 for a, b, v in zip(new.tolist(), ends.tolist(), m[new])]))
    start, value, double = np.concatenate(starts), np.concatenate(values), np.concatenate(twice)
    new = np.concatenate(([True], value[1:] != value[:-1]))
    double |= np.concatenate((~new[1:], [False]))  # goes on in the next segment
    double = np.logical_or.reduceat(double, np.flatnonzero(new))
    start, value = start[new], value[new]
    # Where a text repeats within itself, a run may not end: its parts stay in the same group.
    count = np.diff(np.concatenate((start, [n])))
    parts = -(-count // RUN)
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, value, double = (np.repeat(x, parts) for x in (start, value, double))
    return start + piece * RUN, np.minimum(np.repeat(count, parts) - piece * RUN, RUN), value, double


def _anchor_place(data: bytes, anchor: int, unit: int) -> int:
    """Where the anchor of a run first stands in its text."""
    h, _ = _anchors(np.frombuffer(data, _KIND[unit]), max(_gram(unit), len(data) // unit))
    return int(np.flatnonzero(h.view(np.int64) == anchor)[0])


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest rank before and after it with a smaller position; -1 and n if none.

    All pointers jump at once: where the pointed position is larger, what it points
    to is the next that can be smaller.
    """
    n = len(order)
    out = []
    for turn in (order, order[::-1]):
        held = np.concatenate((turn, [-1]))  # rank -1: below all
        near = np.arange(-1, n - 1)
        open_ = np.flatnonzero(held[near] > turn)
        while len(open_):
            near[open_] = near[near[open_]]
            open_ = open_[held[near[open_]] > turn[open_]]
        out.append(near)
    before, after = out
    return before, n - 1 - after[::-1]


def previous_factors(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each start the earlier start with the same ``size`` bytes that its longest previous factor gives, else -1.

    Ranks of ever longer strings, by doubling, give the order of the suffixes up to
    ``size`` bytes; ``starts`` are in ascending order and leave ``size`` bytes each.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    padded = np.concatenate((data, np.zeros(size, data.dtype))).astype(np.uint64)
    word, span = padded, 1
    while span * data.itemsize < 8 and span * 2 <= size:
        word = (word[:-span] << np.uint64(8 * data.itemsize * span)) | word[span:]
        span *= 2
    rank = _ranks(word)
    while span * 2 <= size:
        rank = _ranks(rank[:-span] * np.uint64(len(rank) + 1) + rank[span:])
        span *= 2
    key = _ranks(rank[starts] * np.uint64(len(rank) + 1) + rank[starts + (size - span)])
    order = np.argsort(key, kind="stable")
    source = np.full(len(starts), -1, np.int64)
    ranked = np.concatenate((key[order].astype(np.int64), [-1]))
    for near in smaller_neighbours(order):
        near = np.where(near >= len(order), -1, near)
        full = np.flatnonzero(ranked[near] == ranked[:-1])  # the common prefix has the full length
        source[order[full]] = order[near[full]]
    return source


def _spans(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at ascending starts cover."""
    if not len(starts):
        return []
    new = np.concatenate(([True], starts[1:] > starts[:-1] + size))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return list(zip(starts[first].tolist(), (starts[last] + size).tolist()))


def _union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Spans without those that overlap or touch, in ascending order."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    last = np.concatenate((first[1:], [len(lo)])) - 1
    return list(zip(lo[first].tolist(), hi[last].tolist()))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = True, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """(doc_id, th, lo, hi): spans of bytes covered by strings of ``min_bytes`` that occur more than once.

    With ``words`` all of this counts words: strings of ``min_bytes`` words, whatever white
    space stands between them, and spans from word to word.  With ``keep_first`` the occurrence with the least (doc_id, digest, position) isn't
    marked.  Spans of a text may overlap and touch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = f"doc_id {kind}, th long"
    unit, read = (4, word_hashes) if words else (1, bytes)
    source = docs.select(*doc_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def split(batches):
        for batch in batches:
            owner, start, count, anchor, twice, digest = [], [], [], [], [], []
            for k, data in enumerate(batch.column("data").to_pylist()):
                data = read(data)
                s, n, m, double = runs(data, min_bytes, unit)
                owner.append(np.full(len(s), k))
                start.append(s), count.append(n), anchor.append(m), twice.append(double)
                digest += [xxhash.xxh3_128_digest(data[a : a + b]) for a, b in zip((s * unit).tolist(), ((n + min_bytes - 1) * unit).tolist())]
            take = pa.array(np.concatenate(owner) if owner else np.zeros(0, np.int64))
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            arrays = [np.concatenate(x) if x else np.zeros(0) for x in (start, count, anchor)]
            arrays = [arrays[0].astype(np.int64), arrays[1].astype(np.int64), arrays[2].astype(np.uint64).view(np.int64), np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1]), np.concatenate(twice).astype(bool) if twice else np.zeros(0, bool)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), *map(pa.array, arrays)], ["doc_id", "th", "start", "n", "m", "d1", "d2", "twice"])

    every = cut(source.mapInArrow(split, f"{key}, start long, n long, m long, d1 long, d2 long, twice boolean"))
    groups = every.groupBy("m").agg(F.count("*").alias("size"), F.min("d1").alias("low"), F.max("d1").alias("high"), F.min("d2").alias("low2"), F.max("d2").alias("high2"), F.max("twice").alias("twice")).where("size > 1 or twice")
    found = cut(every.join(groups.select("m", ((F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2")) | F.col("twice")).alias("mixed")), "m"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "start")
    classes = found.groupBy("m", "d1", "d2").agg(F.count("*").alias("c"), F.min(rank).alias("first"), F.first("n").alias("n"), F.first("mixed").alias("mixed"), F.max("twice").alias("twice"))
    classes = cut(classes.where("c > 1 or mixed"))
    copies = found.join(classes.where("c > 1").select("m", "d1", "d2", "first"), ["m", "d1", "d2"])
    if keep_first:
        copies = copies.where(rank != F.col("first"))
    marked = copies.select("doc_id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (min_bytes - 1)).alias("hi"))

    mixed = classes.where("mixed")
    sizes = mixed.groupBy("m").agg(F.count("*").alias("g"), F.max("twice").alias("wild"))
    # 0: one task takes the group; 1: it is too large; 2: and anchors don't line its runs up, as one stands twice
    case = F.when(F.col("g") <= group, 0).when(~F.col("wild"), 1).otherwise(2)
    wanted = mixed.join(sizes, "m").select("first.doc_id", "first.th", F.struct("first.start", "n", "m", case.alias("case")).alias("run"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs")).withColumnsRenamed({"doc_id": "w", "th": "wh"})
    texts = source.mapInArrow(_pack, f"{key}, data binary")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh"))).select("doc_id", "th", "data", "runs")

    def fetch(batches):
        """The text of each wanted run."""
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            take, rows = [], []
            for k, (packed, wants) in enumerate(zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist())):
                data = read(unpack(packed))
                for r in wants:
                    take.append(k)
                    rows.append((r["m"], r["case"], r["start"], r["n"], data[r["start"] * unit : (r["start"] + r["n"] + min_bytes - 1) * unit]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield _keyed(batch, take, rows, kinds, ["m", "case", "start", "n", "data"])

    fetched = cut(texts.mapInArrow(fetch, f"{key}, m long, case int, start long, n long, data binary"))

    def factor(batches):
        """Spans of windows whose longest previous factor is full, and of their first copies if these go too."""
        held, size = [], 0

        def emit(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held)
            group_of = table.column("m").to_numpy()
            end = len(group_of) if last else int(np.searchsorted(group_of, group_of[-1]))  # rows come sorted
            held = table.slice(end).to_batches() if end < len(group_of) else []
            size = sum(len(x) for x in table.slice(end).column("data").to_pylist())
            table = table.slice(0, end)
            parts = table.column("data").to_pylist()
            length = np.array([len(x) // unit for x in parts], np.int64)
            base = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64)
            windows = length - (min_bytes - 1)
            owner = np.repeat(np.arange(len(parts)), windows)
            starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + base[owner]
            source = previous_factors(np.frombuffer(b"".join(parts), _KIND[unit]), starts, min_bytes)
            hit = source >= 0
            if not keep_first:
                hit[source[hit]] = True
            take, lo, hi = [], [], []
            begin = table.column("start").to_numpy()
            where = np.flatnonzero(hit)
            bounds = np.searchsorted(owner[where], np.arange(len(parts) + 1))
            for k in np.unique(owner[where]).tolist():
                for a, b in _spans(starts[where[bounds[k] : bounds[k + 1]]] - base[k] + begin[k], min_bytes):
                    take.append(k), lo.append(a), hi.append(b)
            take = pa.array(take, pa.int64())
            ids = [table.column(c).combine_chunks().take(take) for c in ("doc_id", "th")]
            ids = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in ids]
            return pa.RecordBatch.from_arrays([*ids, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "th", "lo", "hi"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += held[-1].column("data").nbytes
                if size >= BLOCK:
                    yield emit(False)
        if held:
            yield emit(True)

    small = fetched.where("case = 0").repartition("m").sortWithinPartitions("m", F.col("doc_id").isNull(), "doc_id", "th", "start")
    marked = marked.unionByName(small.mapInArrow(factor, f"{key}, lo long, hi long"))
    return marked.unionByName(_large_groups(fetched.where("case > 0"), key, min_bytes, keep_first, unit))


def _keyed(batch: pa.RecordBatch, take: list[int], rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    """Rows of values, each with doc_id and th of the row of ``batch`` that it comes from."""
    at = pa.array(take, pa.int64())
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "th", *names])


def _large_groups(large: DataFrame, key: str, min_bytes: int, keep_first: bool, unit: int) -> DataFrame:
    """Spans of the runs (doc_id, th, m, case, start, n, data) of groups that are too large for a task."""
    own = [c.split()[0] for c in key.split(", ")] + ["start"]
    alike = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th")) & (F.col(f"{a}.start") == F.col(f"{b}.start"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "start")

    def contexts(batches):
        for batch in batches:
            take, rows = [], []
            for k, (m, start, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "start", "data")))):
                p = _anchor_place(data, m, unit)
                take += [k, k]
                rows += [(m, start, p, 0, data[: p * unit][::-1]), (m, start, p, 1, data[p * unit : (p + min_bytes) * unit])]
            yield _keyed(batch, take, rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["m", "start", "place", "side", "context"])

    def neighbours(batches):
        """What each row shares with the one before or after; unknown, so without bound, at the ends of a task."""
        before, names = None, ["start", "place", "side", "shared"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("m", "side", "context", "start", "place")]
            ids = [batch.column(c).to_pylist() for c in ("doc_id", "th")]
            held = []
            for k, (m, side, context, start, place) in enumerate(zip(*columns)):
                own_best = NO_BOUND if before is None else 0
                if before is not None:
                    common = _shared(before[2], context) // unit if before[:2] == (m, side) else 0
                    held.append((*before[3], max(before[4], common)))
                    own_best = common
                before = (m, side, context, (ids[0][k], ids[1][k], start, place, side), own_best)
            if held:
                yield _plain(held, batch.schema, kinds, names)
        if before is not None:
            yield _plain([(*before[3], NO_BOUND)], batch.schema, kinds, names)

    order = ["m", "side", "context", *own]
    sides = large.where("case = 1").mapInArrow(contexts, f"{key}, m long, start long, place int, side int, context binary")
    shared = sides.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(neighbours, f"{key}, start long, place int, side int, shared int")
    bounds = shared.groupBy(*own).agg(F.max("place").alias("place"), F.max(F.when(F.col("side") == 0, F.col("shared"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("shared"))).alias("right"))
    bounded = large.alias("a").join(bounds.alias("b"), alike("a", "b"), "left").select("a.*", "place", "left", "right")

    def trim(batches):
        for batch in batches:
            take, rows = [], []
            for k, (m, case, start, n, data, place, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "case", "start", "n", "data", "place", "left", "right")))):
                lo, hi = 0, n
                if place is not None:  # a window with the anchor at offset o needs o bytes before it and the rest from it on
                    lo, hi = max(0, place - left), min(n, place + right - min_bytes + 1)
                if lo < hi:
                    part = data[lo * unit : (hi + min_bytes - 1) * unit]
                    take.append(k)
                    rows.append((m, case, start + (place or 0), start + lo, hi - lo, *np.frombuffer(xxhash.xxh3_128_digest(part), np.int64).tolist(), part))
            yield _keyed(batch, take, rows, [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()], ["m", "case", "at", "start", "n", "d1", "d2", "data"])

    trimmed = cut(bounded.mapInArrow(trim, f"{key}, m long, case int, at long, start long, n long, d1 long, d2 long, data binary"))
    kinds_ = trimmed.groupBy("m", "d1", "d2").agg(F.count("*").alias("c"), F.min(rank).alias("first"), F.max("case").alias("kind"))
    ranked = trimmed.join(kinds_, ["m", "d1", "d2"])
    equal = ranked.where("c > 1")
    if keep_first:
        equal = equal.where(rank != F.col("first"))
    spans = equal.select("doc_id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (min_bytes - 1)).alias("hi"))
    # Where all runs have an equal one, only the question which window is the earliest may be open.
    open_ = kinds_.groupBy("m").agg(F.count("*").alias("kinds"), F.min("c").alias("c"), F.max("kind").alias("kind"))
    open_ = open_.where("kinds > 1 or kind = 2" if keep_first else "c = 1 or kind = 2").select("m")
    single = ranked.where(rank == F.col("first")).join(open_, "m", "left_semi")

    def blocks(width: int):
        def cut_up(batches):
            """Blocks of ``width`` windows with their digests; what is left at the ends has none."""
            for batch in batches:
                take, rows = [], []
                for k, (at, start, n, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "start", "n", "data")))):
                    bounds = [start, *range(start + (at - start) % width, start + n, width), start + n]
                    for lo, hi in zip(bounds, bounds[1:]):
                        if lo < hi:
                            part = data[(lo - start) * unit : (hi - start + min_bytes - 1) * unit]
                            digest = np.frombuffer(xxhash.xxh3_128_digest(part), np.int64).tolist() if hi - lo == width else (None, None)
                            take.append(k)
                            rows.append((at, lo, hi - lo, *digest, part if width > 1 else None))
                yield _keyed(batch, take, rows, [*[pa.int64()] * 5, pa.binary()], ["at", "start", "n", "d1", "d2", "data"])

        return cut_up

    rest = single.select(*own, "at", "n", "data")
    for width in WIDTHS:
        parts = cut(rest.mapInArrow(blocks(width), f"{key}, at long, start long, n long, d1 long, d2 long, data binary"))
        least = parts.where("d1 is not null").groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(rank).alias("first"))
        if width == 1:
            met = parts.join(least.where("c > 1"), ["d1", "d2"])
        else:
            met = cut(parts.join(least, ["d1", "d2"]))
            rest = met.where(rank == F.col("first")).select(rest.columns).unionByName(parts.where("d1 is null").select(rest.columns))
        again = met.where((F.col("c") > 1) & (rank != F.col("first")) if keep_first else F.col("c") > 1)
        spans = spans.unionByName(again.select("doc_id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (min_bytes - 1)).alias("hi")))
    return spans


def _plain(rows: list[tuple], schema: pa.Schema, kinds: list, names: list[str]) -> pa.RecordBatch:
    kinds = [schema.field("doc_id").type, schema.field("th").type, *kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "th", *names])


def _pack(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([pack(x) for x in batch.column("data").to_pylist()], pa.binary())], ["doc_id", "th", "data"])


def suffix_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = True, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", passage: int = 0) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept binary, n_passage_words.

    n_passage_words are the words that strings of ``passage`` words cover which start
    anywhere else too, first copies included; nothing is removed for them (0: not looked for).

    Null counts as empty.  Texts shorter than ``min_bytes`` stay whole.  Strings are
    judged on the input, within a text too, and overlaps count.  Rows alike in id and
    text are copies of each other; with ``keep_first`` (later copies go, the first
    stays) they are treated alike and both count as the earlier one.  An empty table
    gives an empty result; other columns of the input are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, min_bytes, keep_first, group, id_col, text_col).withColumn("words", F.lit(False))
    if passage:
        spans = spans.unionByName(repeated_spans(docs, passage, False, group, id_col, text_col, True).withColumn("words", F.lit(True)))
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "words")).alias("spans")).withColumnsRenamed({"doc_id": "w", "th": "wh"})
    texts = docs.select(*doc_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")).mapInArrow(_pack, f"doc_id {kind}, th long, data binary")
    texts = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("th") == F.col("wh")), "left").select("doc_id", "data", "spans")

    def remove(batches):
        for batch in batches:
            unpack, rows = zstandard.ZstdDecompressor().decompress, []
            spans = batch.column("spans")
            for k, packed in enumerate(batch.column("data").to_pylist()):
                data, kept, at, removed, count, words = unpack(packed), [], 0, 0, 0, 0
                if spans[k].is_valid:
                    pair = spans[k].values
                    lo, hi, by_word = (pair.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "words"))
                    words = sum(b - a for a, b in _union(lo[by_word], hi[by_word]))
                    for a, b in _union(lo[~by_word], hi[~by_word]):
                        kept.append(data[at:a])
                        at, removed, count = b, removed + b - a, count + 1
                kept.append(data[at:])
                rows.append((len(data), removed, count, b"".join(kept), words))
            kinds = [*[pa.int64()] * 3, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return texts.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir), MIN_BYTES, keep_first=False, passage=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
