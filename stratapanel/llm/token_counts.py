"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the vocabulary's pattern.  The symbols of a piece
form a linked list, its mergeable adjacent pairs a heap ordered by rank; the
lowest pair is popped and merged until none is left.  A piece counts its initial
symbols less its merges; no identifiers are made.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import documents, texts_of

# The published split pattern of byte-level vocabularies, with
# white space spelled out as Unicode's White_Space property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces no longer than this are remembered, at most so many for each worker.
MEMO_CHARS, MEMO_PIECES = 48, 400_000
#: Texts beyond this many characters are cut into pieces lazily.
LAZY_CHARS = 1_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left after all merges, lowest rank first, leftmost first."""
    n = len(symbols)
    sym: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i] if sym[i] == left else n
        if j >= n or sym[j] != right:
            continue  # one of the two has been merged meanwhile
        sym[i], sym[j], after[i] = left + right, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        merges += 1
        for k, m in ((before[i], i), (i, after[i])):
            if k >= 0 and m < n and (rank := ranks.get((sym[k], sym[m]))) is not None:
                heappush(heap, (rank, k, sym[k], sym[m]))
    return n - merges


class PieceCounts(dict):
    """Counts by piece, filled on demand, emptied when full."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        n = merge_count([self.symbols[b] for b in piece.encode()], self.ranks)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts with the vocabulary in a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.pieces = PieceCounts({p: i for i, p in enumerate(pairs)})
        self.cut = regex.compile(PIECES)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def pieces_of(self, text: str):
        """(piece, tokens) in order; pieces put together are the text, and tokens never cross them."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield from ((x.group(), self.pieces[x.group()]) for x in self.cut.finditer(text[at : m.start()]))
            yield m.group(), 1
            at = m.end()
        yield from ((x.group(), self.pieces[x.group()]) for x in self.cut.finditer(text[at:]))

    def chunks(self, text: str, most: int) -> list[tuple[int, int, int]]:
        """(first character, end, tokens) of successive parts of at most ``most`` tokens; one empty part for an empty text.

        A part ends between pieces; only a piece of more tokens than ``most`` is
        halved until its parts fit, and counted by part.
        """
        out, start, at, total = [], 0, 0, 0
        work: list[str] = []
        for piece, n in self.pieces_of(text):
            work = [piece]
            while work:
                part = work.pop()
                n = self.pieces[part] if part is not piece else n
                if n > most and len(part) > 1:
                    work += [part[len(part) // 2 :], part[: len(part) // 2]]
                    continue
                if total + n > most and total:
                    out.append((start, at, total))
                    start, total = at, 0
                at, total = at + len(part), total + n
        return [*out, (start, at, total)]

    def plain(self, text: str) -> int:
        if len(text) <= LAZY_CHARS:
            return sum(map(self.pieces.__getitem__, self.cut.findall(text)))
        return sum(self.pieces[m.group()] for m in self.cut.finditer(text))

    def __call__(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts count 0 tokens; repeated rows are counted each; other
    columns of the input are not carried, whatever their names.  ``tokenizer`` is
    the path of a byte-level tokenizers file that every executor can open.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        counter = Counter(tokenizer)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            tokens = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def token_pieces(docs: DataFrame, tokenizer: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parts of texts of at most ``most`` tokens: doc_id, piece, start_char, length (tokens), text.

    Parts put together give the text again.  Null and empty texts have one empty part;
    repeated rows are cut each; other columns of the input are not carried.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut_up(batches):
        counter = Counter(tokenizer)
        for batch in batches:
            take, rows = [], []
            for k, text in enumerate(texts_of(batch.column("text"))):
                for i, (lo, hi, n) in enumerate(counter.chunks(text, most)):
                    take.append(k)
                    rows.append((i, lo, n, text[lo:hi]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(take, pa.int64())), *columns], ["doc_id", "piece", "start_char", "length", "text"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(cut_up, f"doc_id {kind}, piece long, start_char long, length long, text string")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
