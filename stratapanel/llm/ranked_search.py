"""Ranked lexical search by MaxScore.

Documents are read once for the terms that the queries hold.  Each task deals its
documents into shards and builds the shard's postings, with an upper bound for each
term.  A query splits its terms by these bounds: documents of which all terms together
can't reach the lowest score that still ranks are never looked at, and the postings of
non-essential terms are probed only for documents that can still qualify.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import cut, documents

#: Queries of one pass over the documents; documents of a shard; documents scored at a time.
QUERY_BLOCK, SHARD, BLOCK = 1024, 16_384, 2_048
#: Salts by which the shards' candidates of a query are ranked first.
SALTS = 64
#: Bytes to what they count as: letters and digits (A to Z lowered) and all that isn't ASCII, or a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def found_terms(docs: DataFrame, places: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of rows with at least one term: all terms with repeats, and the places and counts of those asked for."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    get = places.get

    def run(batches):
        for batch in batches:
            sizes, held, times = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                there, n = np.unique(at[at >= 0], return_counts=True)
                sizes.append(len(words))
                held.append(there)
                times.append(n)
            offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, kind), *x]), pa.from_numpy_dtype(kind))) for x, kind in ((held, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>").where("n > 0")


class Shard:
    """Postings of some documents, by term: documents in ascending order of id, and what the term adds to their scores."""

    def __init__(self, table: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        table = table.take(pc.sort_indices(table.column("doc_id"), null_placement="at_end"))
        self.ids = table.column("doc_id").combine_chunks()
        size = table.column("n").to_numpy().astype(np.int64)
        length = 75 + 25 * size * n_docs // n_terms
        lists = table.column("terms").combine_chunks()
        term, tf = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(len(size)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        term, tf = term[order], tf[order]
        self.adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length[self.docs]))
        held, first = np.unique(term, return_index=True)
        self.where = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)])))
        self.bound = dict(zip(held.tolist(), np.maximum.reduceat(self.adds, first).tolist())) if len(held) else {}

    def best(self, query: list[tuple[int, int]], k: int, ranked: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of up to ``k`` documents that may rank beside ``ranked``, the k highest scores seen elsewhere.

        ``query`` holds (term, repeats).
        """
        lists = sorted((self.bound[t] * r, *self.where[t], r) for t, r in query if self.bound.get(t, 0) > 0)
        reach = np.cumsum([x[0] for x in lists])  # what the lists up to each can add together
        pos, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = ranked[-1] if len(ranked) == k else 1
        for low in range(0, len(self.ids), BLOCK):
            high = min(low + BLOCK, len(self.ids))
            essential = int(np.searchsorted(reach, least))  # all before it together stay below least
            if essential == len(lists):
                break
            sums = np.zeros(high - low, np.int64)
            for _, a, b, r in lists[essential:]:
                a, b = a + np.searchsorted(self.docs[a:b], (low, high))
                sums[self.docs[a:b] - low] += r * self.adds[a:b]
            may = np.flatnonzero(sums)
            for i in range(essential - 1, -1, -1):
                may = may[sums[may] + reach[i] >= least]
                if not len(may):
                    break
                _, a, b, r = lists[i]
                at = a + np.searchsorted(self.docs[a:b], may + low)
                hit = (at < b) & (self.docs[np.minimum(at, b - 1)] == may + low)
                sums[may[hit]] += r * self.adds[at[hit]]
            may = may[sums[may] >= least]
            if len(may):
                pos, score = np.append(pos, may + low), np.append(score, sums[may])
                top = np.lexsort((pos, -score))[:k]
                pos, score = pos[top], score[top]
                both = sorted([*ranked, *score.tolist()], reverse=True)[:k]
                least = both[-1] if len(both) == k else 1
        keep = score >= least
        return pos[keep], score[keep]


def _block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(q, doc_id, score) of the k best for each query text of ``block``, numbered from 0."""
    asked = [Counter(terms(text)) for _, text in block]
    places = {t: i for i, t in enumerate(sorted({t for q in asked for t in q}))}
    rows = cut(found_terms(docs, places, id_col, text_col))
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(places), np.int64)
    for t, df in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the queries' terms
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    queries = [[(places[t], r) for t, r in q.items()] for q in asked]

    def run(batches):
        ranked: list[list[int]] = [[] for _ in queries]

        def search(held):
            shard = Shard(pa.Table.from_batches(held), weights, n_docs, n_terms)
            which, at, scores = [], [], []
            for q, query in enumerate(queries):
                pos, score = shard.best(query, k, ranked[q])
                if len(pos):
                    ranked[q] = sorted([*ranked[q], *score.tolist()], reverse=True)[:k]
                    which.append(np.full(len(pos), q, np.int32))
                    at.append(pos)
                    scores.append(score)
            if which:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), shard.ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], ["q", "doc_id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield from search(held)
                held = []
        if held:
            yield from search(held)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.where(F.size("terms") > 0).mapInArrow(run, f"q int, doc_id {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each row of ``queries``: item_id, rank, doc_id, score.

    Equal scores rank by ascending doc_id, null last; rows alike in both are
    interchangeable, and repeated rows rank each.  Null texts and texts without a term
    neither count nor rank; a query without a term has no rows, a repeated query repeats
    its rows.  Empty tables give an empty result; other columns aren't carried, whatever
    their names.  Queries are read in blocks of QUERY_BLOCK, each a pass over the documents.
    """
    spark = docs.sparkSession
    items = queries.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("query"))
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    rows = items.toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        found = _block(docs, block, k, id_col, text_col)
        if found is None:
            break
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
        some = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"q int, item_id {kinds[0]}")
        out = out.unionByName(top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {
    "op12_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM d),
s AS (SELECT count(DISTINCT r) AS nd, count(*) AS l FROM t),
c AS (SELECT r, doc_id, n, w, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT row_number() OVER () AS q, item_id, {_LOWER} AS ws FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT q, item_id, w, count(*) AS times FROM (SELECT q, item_id, unnest(ws) AS w FROM i) GROUP BY ALL),
f AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM c, s WHERE w IN (SELECT w FROM a) GROUP BY w, nd),
x AS (SELECT q, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
      FROM a JOIN f USING (w) JOIN c USING (w), s GROUP BY ALL),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""
}
