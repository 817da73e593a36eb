import math
import random
import re
from collections import Counter

import duckdb
import pytest

from stratapanel.llm import ranked_search as m

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))


def brute(rows, queries, k=20):
    docs = [(d, Counter(words(t))) for d, t in rows if words(t)]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for item, text in queries:
        scored = []
        for d, c in docs:
            m_ = 75 + 25 * sum(c.values()) * n_docs // total
            s = 0
            for w, r in Counter(words(text)).items():
                if tf := c[w]:
                    df = sum(w in x for _, x in docs)
                    s += r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m_))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def collected(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 80)))) for i in range(300)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 460)] + [(7, "another text of id w3 w3"), (None, "no id w5"), (None, None), (900, ""), (901, "..."), (902, "W1, W2;É é W1")]
    queries = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 15)))) for i in range(20)] + [(50, "w1 w1 w1 É"), (51, None), (52, "none of these"), (53, "!!"), (50, "w2")]
    return rows, queries


@pytest.mark.parametrize("shard, block, queries_at_once", [(16_384, 2_048, 1_024), (50, 7, 4), (1, 1, 100)])
def test_equals_brute_force(spark, corpus, monkeypatch, shard, block, queries_at_once):
    rows, queries = corpus
    monkeypatch.setattr(m, "SHARD", shard)
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "QUERY_BLOCK", queries_at_once)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    for k in (3, 20):
        assert collected(m.search(docs, asked, k)) == brute(rows, queries, k)


def test_bounds_spare_work(corpus):
    """Documents below the lowest ranking score aren't returned, and lists that can't reach it alone aren't scanned."""
    import numpy as np
    import pyarrow as pa

    n = 5000
    table = pa.table({"doc_id": np.arange(n), "n": np.full(n, 10), "terms": [[0, 1] if i % 100 == 0 else [0] for i in range(n)], "tfs": [[1, 1] if i % 100 == 0 else [1] for i in range(n)]})
    table = table.cast(pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))]))
    shard = m.Shard(table, np.array([1, 5000]), n, 10 * n)
    pos, score = shard.best([(0, 1), (1, 1)], 20, [])
    assert len(pos) == 20 and (pos % 100 == 0).all() and (np.diff(score) == 0).all() and (np.diff(pos) > 0).all()
    assert not len(shard.best([(0, 1), (1, 1)], 20, [int(score[0]) + 1] * 20)[0])


def test_edge_rows(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    queries = [(1, "MIT license"), (2, "repeated row"), (3, "ünï éé")]
    asked = spark.createDataFrame([(*q, 1) for q in queries], "item_id long, text string, doc_id int")
    assert collected(m.search(edge, asked)) == brute(rows, queries)
    assert m.search(empty, asked).collect() == []
    assert m.search(edge, asked.limit(0)).collect() == []
    odd = edge.withColumn("meta.url", edge["size"]).withColumn("q", edge["size"]).withColumn("terms", edge["size"])
    assert collected(m.search(odd, asked)) == brute(rows, queries)


def test_terms_are_those_of_the_pattern():
    every = "".join(map(chr, [*range(0x250), 0x2000, 0x212A, 0x3000, 0x1F600]))
    mixed = "".join(random.Random(4).choices(every, k=5000))
    for text in (every, mixed, " a" + mixed):
        assert [w.decode() for w in m.terms(text)] == words(text)


def test_equals_sql(spark, corpus, tmp_path):
    rows, queries = corpus
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    with duckdb.connect() as db:
        for name, df in (("documents", docs), ("benchmark", asked)):
            df.write.parquet(path := str(tmp_path / name))
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
        expected = sorted(db.sql(m.ORACLES["op12_ranked_search"]).fetchall(), key=repr)
    assert collected(m.search(docs, asked)) == expected
