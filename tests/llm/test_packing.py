from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from stratapanel.llm import packing as m


def exhaustive(lengths, counts, buckets):
    best = None
    for inner in combinations(lengths[:-1], min(buckets, len(lengths)) - 1):
        bounds = [*inner, lengths[-1]]
        cost = sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.choice(60, rng.integers(1, 12), replace=False).tolist())
    counts = rng.integers(1, 50, len(lengths)).tolist()
    for k in (1, 2, 3, 4):
        bounds = m.optimal_boundaries(lengths, counts, k)
        assert bounds[-1] == lengths[-1] and len(bounds) == min(k, len(lengths))
        assert sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts)) == exhaustive(lengths, counts, k)
    assert m.optimal_boundaries([], [], 3) == []


def check(rows, sizes, max_length, budget):
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        batches[r["bucket"], r["batch"]].append(r)
        assert r["padding"] == r["bucket_length"] - r["length"] >= 0
    for d, n in sizes.items():
        mine = sorted(pieces[d], key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == n and [r["start_word"] for r in mine] == [max_length * k for k in range(len(mine))]
        assert all(r["length"] == max_length for r in mine[:-1])
    full = defaultdict(list)
    for (bucket, batch), rows_ in batches.items():
        assert sorted(r["slot"] for r in rows_) == list(range(len(rows_)))
        assert len(rows_) == 1 or len(rows_) * rows_[0]["bucket_length"] <= budget
        full[bucket].append((batch, len(rows_)))
    for counts in full.values():
        counts.sort()
        assert [b for b, _ in counts] == list(range(len(counts))) and len({n for _, n in counts[:-1]}) <= 1


def test_batches(spark):
    sizes = {i: (i * i) % 90 for i in range(500)} | {1000: 700}
    docs = spark.createDataFrame([(d, "w " * n) for d, n in sizes.items()], "doc_id long, text string").repartition(5)
    rows = m.pack(docs, max_length=64, buckets=4, budget=500, digits=1).collect()
    check(rows, sizes, 64, 500)
    assert sorted(map(repr, rows)) == sorted(map(repr, m.pack(docs.repartition(2), max_length=64, buckets=4, budget=500, digits=1).collect()))


def test_edge_cases(edge, empty):
    rows = m.pack(edge).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edge.select("doc_id").collect()}
    assert sum(r["length"] for r in rows) == sum(len((r["text"] or "").split()) for r in edge.select("text").collect())
    assert sum(r["doc_id"] == 12 for r in rows) == 2
    assert m.pack(empty).collect() == []


def test_equals_sql(spark, oracle):
    from tests.llm.conftest import same

    docs = spark.createDataFrame([(i, "w " * (i * 37 % 3000)) for i in range(150)], "doc_id long, text string")
    same(m.pack(docs).collect(), oracle(docs, m._oracle()))


def test_token_pieces_rebuild_texts(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(200, "x" * 5000), (201, "one <|endoftext|> two"), (202, "a  b \n\n c   "), (203, "word " * 3000)]
    docs = edge.select("doc_id", "text", "n_lines").unionByName(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n_lines long"))
    rows = m.pack_tokens(docs, path, max_length=64, buckets=4, budget=500, digits=1).collect()
    exact = Tokenizer.from_file(path)
    by_doc = defaultdict(list)
    batches = defaultdict(list)
    for r in rows:
        assert r["length"] == len(exact.encode(r["text"], add_special_tokens=False).ids) <= 64 and r["padding"] == r["bucket_length"] - r["length"] >= 0
        by_doc[r["doc_id"]].append(r)
        batches[r["bucket"], r["batch"]].append(r)
    for batch in batches.values():
        assert sorted(r["slot"] for r in batch) == list(range(len(batch))) and (len(batch) == 1 or len(batch) * batch[0]["bucket_length"] <= 500)
    expected = defaultdict(list)
    for r in docs.collect():
        expected[r["doc_id"]].append(r["text"] or "")
    for d, whole in expected.items():
        mine = sorted(by_doc[d], key=lambda r: r["piece"])
        if len(whole) == 1:
            assert "".join(r["text"] for r in mine) == whole[0] and all(whole[0][r["start_char"] :].startswith(r["text"]) for r in mine)
        assert sum(len(r["text"]) for r in mine) == sum(map(len, whole))
    assert max(sum(r["length"] for r in b) for b in batches.values()) > 250
