import random
import re

import numpy as np
import pytest

from stratapanel.llm import suffix_dedup as m

SIZE = 100


def brute(rows, size, keep_first):
    """Marks all windows that occur elsewhere, or earlier in order of (id, position)."""
    data = [((d is None, d, k), (t or "").encode()) for k, (d, t) in enumerate(rows)]
    at = {}
    for key, b in sorted(data, key=lambda x: (x[0][0], x[0][1] or 0, x[0][2])):
        for i in range(len(b) - size + 1):
            at.setdefault(b[i : i + size], []).append((key, i))
    out = []
    for key, b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - size + 1):
            places = at[b[i : i + size]]
            if len(places) > 1 and not (keep_first and places[0] == (key, i)):
                covered[i : i + size] = b"\1" * size
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((key[1], len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), kept))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 4)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60), make(25), "xyz" * 60, make(200)]
    rows = []
    for d in range(40):
        parts = [rng.choice([make(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 50) :]]) for _ in range(rng.randint(0, 5))]
        rows.append((d, "".join(parts)))
    return [*rows, (100, None), (101, ""), (102, "q" * 5000), (103, rows[3][1]), (104, "é" * 200)]


@pytest.mark.parametrize("group", [2, 64])
@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, keep_first, group):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = m.suffix_dedup(docs, SIZE, keep_first, group).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == brute(rows, SIZE, keep_first)


def test_edge_cases(edge, empty):
    got = m.suffix_dedup(edge, SIZE, keep_first=False).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=repr) == brute(rows, SIZE, False)
    assert m.suffix_dedup(empty).collect() == []


def test_smaller_neighbours():
    order = np.random.default_rng(0).permutation(500)
    before, after = m.smaller_neighbours(order)
    for r, x in enumerate(order):
        assert before[r] == max((q for q in range(r) if order[q] < x), default=-1)
        assert after[r] == min((q for q in range(r + 1, 500) if order[q] < x), default=500)


def test_long_text_over_segments():
    rng = random.Random(5)
    data = bytes(rng.choices(range(256), k=m.SEGMENT * 2 + 777))
    start, n, value, twice = m.runs(data, 400)
    assert start[0] == 0 and n.sum() == len(data) - 399 and (np.diff(start) == n[:-1]).all() and twice.sum() <= 2  # those that go on in the next segment
    part, *_ = m.runs(data[m.SEGMENT - 5000 : m.SEGMENT + 5000], 400)
    assert set((part[1:-1] + m.SEGMENT - 5000).tolist()) <= set(start.tolist())


def test_periodic_texts_come_in_parts(spark):
    rows = [(1, "ab" * 400_000), (2, "the same five words again " * 30_000), (3, "x" * 399), (4, "y" * 400), (5, "".join(chr(97 + i * i % 23) for i in range(700)))]
    for _, t in rows:
        start, n, _, _ = m.runs(t.encode(), 400)
        assert n.sum() == max(0, len(t) - 399) and (len(n) == 0 or n.max() <= m.RUN) and (np.diff(start) == n[:-1]).all()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in m.suffix_dedup(docs, 400, keep_first=False).collect()}
    assert got == {d: (len(t), *m_brute(t)) for d, t in rows}


def m_brute(text):
    """Bytes and spans of one text that repeats nothing of others."""
    seen, covered, spans, end = {}, 0, 0, -1
    for i in range(len(text) - 399):
        seen[text[i : i + 400]] = seen.get(text[i : i + 400], 0) + 1
    for i in range(len(text) - 399):
        if seen[text[i : i + 400]] > 1:
            covered += i + 400 - max(i, end)
            spans += i > end
            end = i + 400
    return covered, spans
