"""Language identification with language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: the cells of all filters stand
side by side, so that the AND of a few cells is a bitmask of all languages that
contain an n-gram.  A text's n-grams are looked up, the bits counted for each
language, and the counts corrected for the false positives that the fill of each
filter makes likely.  The language with the largest corrected count wins.

A language's filter holds the n-grams that are frequent in it, and not much
rarer than in any other language.  They are learned from a sample of about
FIT_DOCS labelled documents for each language.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stratapanel.llm.common import cut, documents, free, near, plainly

#: Expected labelled documents for each language in the sample; lengths of n-grams.
FIT_DOCS, ORDERS = 1500, (3, 4)
#: N-grams kept for each language, least count, least share of the best relative frequency.
TOP, MIN_COUNT, MIN_SHARE = 60_000, 3, 0.3
#: Cells of a filter (a power of two) and probes for each n-gram.
CELLS, PROBES = 1 << 20, 2
#: Characters handled at a time.
CHUNK = 1 << 19
UNKNOWN = "und"


#: Whether each code point is a letter, filled on first use: a plain list travels to executors by value.
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def grams(chars: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all n-grams of code points; 0 where an n-gram holds no letter."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = chars.astype(np.uint64)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = h * np.uint64(0x100000001B3) + wide[i : i + n]
    h = _mix(h)
    blank = np.ones(n, bool)
    for i in range(order):
        blank &= chars[i : i + n] == 32
    h[blank] = 0
    return h


def pieces(texts: list[str]):
    """(code points, document number of each) of runs of texts: lower case, non-letters as single spaces.

    Long texts come in several runs that overlap by the longest n-gram less one.
    """
    lap = max(ORDERS) - 1
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            part = text[max(0, at - lap) : at + CHUNK]
            chars = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            chars = np.where(_letters()[chars], chars, np.uint32(32))
            chars = chars[np.concatenate(([True], (chars[1:] != 32) | (chars[:-1] != 32)))] if len(chars) else chars
            chars = np.concatenate(([32], chars, [32] * (lap + 1))).astype(np.uint32)  # no n-gram crosses texts but of blanks
            held.append(chars)
            owner.append(np.full(len(chars), k, np.int32))
            size += len(chars)
            if size >= CHUNK:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owner)


class Filters:
    """Bit-sliced Bloom filters: cell i holds a bitmask of the languages that set it."""

    def __init__(self, languages: list[str], contents: dict[str, np.ndarray]):
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        self.cells = np.zeros((CELLS, self.words), np.uint64 if len(languages) > 8 else np.uint8)
        for k, lang in enumerate(languages):
            bit = self.cells.dtype.type(1 << (k % 64))
            for probe in self._probes(contents[lang]):
                self.cells[probe, k // 64] |= bit
        bits = self._bits(self.cells)
        self.false = np.array([bits(k).mean() for k in range(len(languages))]) ** PROBES

    def _probes(self, h: np.ndarray):
        for _ in range(PROBES):
            yield (h & np.uint64(CELLS - 1)).astype(np.int64)
            h = h >> np.uint64(CELLS.bit_length())

    @staticmethod
    def _bits(masks: np.ndarray):
        return lambda k: (masks[:, k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages whose filter contains it."""
        out = None
        for probe in self._probes(h):
            out = self.cells[probe] if out is None else out & self.cells[probe]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hits by text and language, and n-grams by text."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for chars, owner in pieces(texts):
            for order in ORDERS:
                h = grams(chars, order)
                use = h != 0
                h, who = h[use], owner[: len(use)][use]
                total += np.bincount(who, minlength=len(texts))
                bits = self._bits(self.masks(h))
                for k in range(len(self.languages)):
                    hits[:, k] += np.bincount(who, weights=bits(k), minlength=len(texts))
        return hits, total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language and score, then the winner's corrected hits and its lead over the second, both by n-gram, and n-grams."""
        none = np.zeros(len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), none, none, none, none
        hits, total = self.counts(texts)
        real = np.maximum(hits - total[:, None] * self.false, 0) / (1 - self.false)
        best = real.argmax(axis=1)
        top, every = real.max(axis=1, initial=0), real.sum(axis=1)
        second = np.sort(real, axis=1)[:, -2] if len(self.languages) > 1 else none
        score = np.where(every > 0, top / np.where(every > 0, every, 1), 0.0)
        lettered = np.fromiter(map(has_letters, texts), bool, len(texts))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)]
        most = np.maximum(total, 1)
        return names, np.where(lettered, score, 0.0), top / most, (top - second) / most, total


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Filters:
    """Filters from a table (key, text, lang); rows without a language are left out.

    The sample takes the rows whose hashed key is low, about ``fit_docs`` of each
    language and all if there are fewer; its texts are read whole.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = near(cut(labelled.groupBy("lang").agg(F.count("*").alias("n"))))  # a row for each language
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    sample = labelled.join(sizes, "lang").where(draw * F.col("n") < F.lit(fit_docs) * F.lit(1 << 20)).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                for chars, _ in pieces([t for t, x in zip(texts, langs) if x == lang]):
                    h = np.concatenate([grams(chars, order) for order in ORDERS])
                    h, n = np.unique(h[h != 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    totals = found.groupBy("lang").agg(F.sum("n").alias("all"))
    rate = found.join(totals, "lang").withColumn("rate", F.col("n") / F.col("all"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))
    kept = rate.withColumn("best", best).where(F.col("rate") >= MIN_SHARE * F.col("best")).withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "gram").toPandas()
    languages = sorted(kept["lang"].unique().tolist())
    return Filters(languages, {x: kept.loc[kept["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in languages})


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), evidence: bool = False) -> DataFrame:
    """One row for each input row: doc_id, the columns in ``keep``, lang_pred, score; with ``evidence`` also rate, lead, grams.

    A null, empty or letterless text is ``und`` with score 0.  The score is the
    winner's part of all corrected counts; of equal counts the first language by
    code point wins, with score 0 where no language is hit.  Without any learned
    language all rows are ``und``.  Repeated rows get equal results; columns
    that aren't named are not carried.  Where ``keep`` has a name of the results, the
    result is called pred_<name>.
    """
    held = filters
    _letters()  # filled here, it reaches the tasks ready
    names = free(["lang_pred", "score", *(("rate", "lead", "grams") if evidence else ())], ["doc_id", *keep], "pred_")
    picked = plainly(docs.select(F.col(id_col), *(f"`{c}`" for c in keep), F.col(text_col)))
    schema = StructType([*picked.schema.fields[:-1], StructField("lang", StringType()), *(StructField(f"figure{i}", DoubleType()) for i in range(1, len(names)))])

    made = schema.names

    def predict(batches):
        for batch in batches:
            *rest, texts = batch.columns
            langs, *figures = held.judge([t or "" for t in texts.to_pylist()])
            found = [pa.array(langs, pa.string()), *map(pa.array, figures)][: len(names)]
            yield pa.RecordBatch.from_arrays([*rest, *found], made)

    return picked.mapInArrow(predict, schema).toDF("doc_id", *keep, *names)


def split_off(docs: DataFrame) -> DataFrame:
    """Adds held_out: whether crc32 of the id as text leaves 2 when divided by 4."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.withColumn("held_out", F.pmod(crc, F.lit(4)) == 2)


def training(docs: DataFrame) -> DataFrame:
    return split_off(docs).where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(split_off(docs), fit(training(docs)), keep=("held_out",))


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
