"""What the text operators share: materialising, table access, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it (for Java and RE2 patterns).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark's switch for dropping an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The cluster names the folder in spark.checkpoint.dir.  Where that is unset,
    a local session gets a throw-away folder and any other the warehouse.  Nothing
    reads the shuffle files of ``df`` again, so Spark drops them.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.startswith("local["):
            named = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # planned anew, under this setting
    finally:
        spark.conf.set(_CLEANUP, before)


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns that tell rows apart without a unique id: (doc_id, text digest).

    Rows alike in both are interchangeable, so every operator that joins on this
    key gives repeated rows the same result.
    """
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]


def free(names: list[str], taken: list[str], prefix: str) -> list[str]:
    """The names; those that a column of ``taken`` has, whatever its case, with ``prefix`` before them."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = prefix + name
        held.add(name.lower())
        out.append(name)
    return out


def plainly(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ... in place of its own: functions over batches take columns by plain name, which one with a dot isn't."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


#: Rows of a few dozen bytes each that are sent to all executors rather than shuffled.
FEW_ROWS = 10_000


def near(small: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``small`` marked for broadcast if a count shows that it is; else as it is, for a shuffled join.

    For tables with a row for each source or language only: what grows with the
    documents is joined by ``meet``.  ``small`` should be materialised.
    """
    return F.broadcast(small) if small.count() <= rows else small


def meet(rows: DataFrame, facts: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of wide rows with narrow facts, at most a few for each row: both are shuffled by key, and only the facts are hashed.

    So texts are neither sorted nor sent to all executors, whatever the size of either side.
    """
    return rows.join(facts.hint("shuffle_hash"), on, how)
