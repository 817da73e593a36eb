"""From raw documents to packed batches, in five stages.

Each stage works on all that the one before it kept, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import language, line_dedup, mixing, packing, simhash
from stratapanel.llm.common import cut, documents

#: Part of a text's n-grams that its language must hold: whatever the second holds, or with a lead over it.
#: None of this depends on the number of languages.  Texts of fewer n-grams (some 100 characters) aren't judged.
PLAIN_RATE, MIN_RATE, MIN_LEAD, MIN_GRAMS = 0.5, 0.25, 0.1, 200
#: Words of a shingle of the near stage.
SHINGLE = 5
#: Jaccard similarity of shingle sets from which texts are near copies.
SIMILAR = 0.8
#: Vocabulary in whose tokens lengths and batches are measured.
TOKENIZER = "byte_bpe_50k.json"


def _columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*(f"`{c}`" for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no learned language; fills in missing languages.

    Texts too short to judge stay, and all texts with letters where no language is
    learned.  Null and empty texts go, as they have no letters; rows are judged each,
    so repeated rows fare alike; an empty table stays empty.
    """
    filters = language.fit(language.training(docs))
    keep = tuple(c for c in docs.columns if c != "doc_id")
    if not filters.languages:
        return docs.where(F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, filters, keep=keep, evidence=True)
    lang_pred, _, rate, lead, grams = (F.col(c) for c in found.columns[-5:])
    spoken = (rate >= PLAIN_RATE) | ((rate >= MIN_RATE) & (lead >= MIN_LEAD))
    found = found.where((lang_pred != language.UNKNOWN) & (spoken | (grams < MIN_GRAMS)))
    return _columns(docs, found.withColumn("lang", F.coalesce("lang", F.when(rate > 0, lang_pred))))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and documents of which nothing is left.

    Documents that lose no line stay, null and empty texts too.  The earliest line by
    id stays, null ids last; rows alike in id and text keep the same lines.
    """
    gone = "__stage_gone"
    left = line_dedup.line_dedup(docs, counts=("__stage_lines", gone, "__stage_near")).where((F.col(gone) == 0) | F.col("text").rlike(line_dedup.WORD))
    return _columns(docs, left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest id, null last.

    Null, empty and blank texts are copies of each other; of rows alike in id and text
    one stays; an empty table stays empty.
    """
    return _columns(docs, simhash.one_of_similar(docs, SHINGLE, SIMILAR))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that the sources have their shares.

    Null is a source of its own.  Texts without words are in the whole copies of their
    source, but never in its sample; rows alike share what is taken of them.
    """
    return _columns(docs, mixing.repeat(docs, cut(mixing.mix(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into length buckets and batches, in tokens, with the text of each piece.

    A null or empty text is one piece of no tokens; each copy of a document is packed.
    """
    import public_tokenizers

    return packing.pack_tokens(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near", dedup_near),
    ("mix", mix_sources),
    ("pack", pack),
]

#: Language ID and SimHash can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
