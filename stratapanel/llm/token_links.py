"""Alignment of two tokenizers' tokens of the same texts.

The byte lengths of each side's tokens are summed to ends; offsets where both sides
end cut the text into groups.  Each A token is linked with a run of B tokens, which
repeats expand to pairs.  Pairs are counted over the corpus in two shuffles, the first
of them salted, and the counts go back to the documents.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import cut, documents
from stratapanel.llm.token_counts import PIECES, byte_symbols

#: Texts of this length are given to the tokenizers in parts, each cut at a space where both sides start a token.
PART_CHARS = 1 << 18
_BOUNDARY = re.compile(r"(?<=\S) (?=[A-Za-z])")
#: Salts of the first shuffle, and of the join where the counts aren't sent to all tasks.
SALTS = 16
#: Input rows whose links make one output batch.
ROWS = 512


def parts(text: str):
    """Parts of ``text`` and the single spaces that are left out between them."""
    at = 0
    while len(text) - at >= PART_CHARS and (m := _BOUNDARY.search(text, at + PART_CHARS // 2)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets where tokens of both sides end, and the group of each token."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return common, np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (left, right) of all pairs where left i is linked with the run low[i]..high[i] - 1."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


#: Rules of a link, from ends and groups of both sides: tokens that end together, or all of a group with each other.
RULES = {
    "ends": lambda a_ends, b_ends, a_group, b_group: (np.searchsorted(b_ends, a_ends), np.searchsorted(b_ends, a_ends, side="right")),
    "groups": lambda a_ends, b_ends, a_group, b_group: (np.searchsorted(b_group, a_group), np.searchsorted(b_group, a_group, side="right")),
}


def same_merges(path: str, entries: dict[int, bytes]):
    """An encoder by ranks that gives the ids of the byte-level vocabulary in ``path``; None if its ids aren't in the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {t["id"] for t in spec["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] or merged != sorted(set(merged)):
        return None
    return tiktoken.Encoding("same merges", pat_str=PIECES, mergeable_ranks={b: i for i, b in entries.items() if i not in added}, special_tokens={})


class Sides:
    """Both tokenizers, and the bytes of each of their tokens.

    Where the vocabulary of A allows it, parts of at most PART_CHARS are encoded by ranks, in a
    third of the time; the library of A encodes longer ones, whose repeats can exhaust the other's stack.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.library, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.library.encode_special_tokens = True
        back = {c: b for b, c in byte_symbols().items()}
        entries = {i: bytes(map(back.__getitem__, entry)) for entry, i in self.library.get_vocab().items()}
        self.by_ranks = same_merges(a_path, entries)
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.names = np.array([[f"{i}{mark}" for i in ids] for mark in ",|;"], object)

    @property
    def pairs_bound(self) -> int:
        """Pairs of ids that can end together: one token's bytes end the other's."""
        return int(self.a_size.sum() + self.b_size.sum())

    def a(self, text: str) -> list[int]:
        if self.by_ranks is None or len(text) > PART_CHARS:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.by_ranks.encode_ordinary(text)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space and text by A, of text by B; none if either side's bytes aren't space and text."""
        a: list[int] = []
        b: list[int] = []
        for part in parts(text) if text else ():
            whole = " " + part
            x, y = self.a(whole), self.b.encode(part)
            data = whole.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) != data or b"".join(map(self.b_bytes.__getitem__, y)) != data:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            a += x
            b += y
        return np.array(a, np.int64), np.array(b, np.int64)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])

    def written(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(a):
            return ""
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = self.names[np.append(np.diff(a_group), 1).clip(0, 1), a]
        out[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = self.names[2 * np.append(np.diff(b_group), 1).clip(0, 1), b]
        return "".join(out.tolist())[:-1]


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each group: doc_id, number (from 0), start and stop (bytes of space and text), a_ids, b_ids.

    Null and empty texts, and those that either side doesn't keep byte for byte, have no
    groups.  Rows are cut each, so repeated rows repeat; other columns aren't carried,
    whatever their names.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        sides = Sides(a_path, b_path)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                a, b = sides.tokens(text)
                if not len(a):
                    continue
                common, a_group, b_group = cuts(*sides.ends(a, b))
                n = len(common)
                lists = [pa.LargeListArray.from_arrays(np.searchsorted(g, np.arange(n + 1)), x.astype(np.int32)).cast(pa.list_(pa.int32())) for g, x in ((a_group, a), (b_group, b))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.full(n, i))), pa.array(np.arange(n)), pa.array(np.append(0, common[:-1])), pa.array(common), *lists], ["doc_id", "number", "start", "stop", "a_ids", "b_ids"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, number long, start long, stop long, a_ids array<int>, b_ids array<int>")


def linked(docs: DataFrame, a_path: str, b_path: str, rule: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times.

    ``pairs`` are the distinct id pairs that the row's links hold, as a * (ids of B) + b,
    and ``times`` how many links hold each.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    runs = RULES[rule]

    def run(batches):
        sides = Sides(a_path, b_path)
        width = len(sides.b_bytes)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                facts: list[tuple] = []
                pairs: list[np.ndarray] = []
                times: list[np.ndarray] = []
                for text in batch.column("text").to_pylist():
                    a, b = sides.tokens(text)
                    ends = sides.ends(a, b)
                    common, *groups = cuts(*ends)
                    left, right = expand(*runs(*ends, *groups))
                    held, n = np.unique(a[left] * width + b[right], return_counts=True)
                    pairs.append(held)
                    times.append(n)
                    digest = hashlib.sha256(s.encode()).hexdigest() if (s := sides.written(a, b, *groups)) else ""
                    facts.append((len(a), len(b), len(common), len(left), digest))
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.zeros(0, np.int64)]), pa.int64())) for x in (pairs, times)]
                columns = [pa.array(c, t) for c, t in zip(zip(*facts), (*[pa.int64()] * 4, pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(held: DataFrame, width: int) -> DataFrame:
    """(pair, count, is_best) of rows with pairs and times: links that hold the pair, and whether no pair of its B id has more.

    Tasks of the first shuffle combine a pair's rows by salt, those of the second its
    salts, so that no task gets a row from every task that has the pair.
    """
    rows = held.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).select("x.pairs", "x.times", "salt")
    salted = rows.groupBy("pairs", "salt").agg(F.sum("times").alias("n"))
    counts = cut(salted.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("count")))
    best = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(best, F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def _met(rows: DataFrame, counts: DataFrame, sent: bool) -> DataFrame:
    """Rows (rid, pair, times) with the counts of their pairs: sent to all tasks, or shuffled with each count once for each salt."""
    if sent:
        return rows.join(F.broadcast(counts), "pair")
    salts: Column = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(counts.withColumn("salt", F.explode(salts)), ["pair", "salt"])


def align(docs: DataFrame, a_path: str, b_path: str, rule: str = "ends", sent_pairs: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair's count is the number of links of all rows that hold it.  ``n_best`` are
    the row's links whose count is the highest of their B id, ties included; ``count_sum``
    sums the counts over its links.  Null and empty texts, and texts that either side
    doesn't keep byte for byte, have no tokens: zeros, and an empty string for the digest.
    Repeated rows count each, as do rows that share an id; an empty table gives an empty
    result; other columns of the input aren't carried, whatever their names.

    Tokens that end together have one's bytes at the other's end, so pairs of the rule
    ``ends`` are at most the bytes of both vocabularies; where a count shows that they keep
    within ``sent_pairs`` (that bound), they are sent to all tasks.  Else they are shuffled.
    """
    sides = Sides(a_path, b_path)
    width, bound = len(sides.b_bytes), sides.pairs_bound if sent_pairs is None else sent_pairs
    facts = cut(linked(docs, a_path, b_path, rule, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    counts = cut(pair_counts(facts, width))
    rows = facts.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = _met(rows, counts, counts.count() <= bound).groupBy("rid").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = facts.drop("pairs", "times").join(sums, "rid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_links": op11_token_links}
ORACLES: dict[str, str] = {}
