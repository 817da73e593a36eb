"""Passages of over 50 words that stand anywhere else too are counted, whatever their bytes; only 400-byte strings go."""

import random
import re

import numpy as np
import pytest

from stratapanel.llm import suffix_dedup as m

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(rng, count):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(count)]


def brute(rows, size):
    """Words of each row that strings of ``size`` words cover which start anywhere else."""
    texts = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - size + 1):
            seen[tuple(t[i : i + size])] = seen.get(tuple(t[i : i + size]), 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        covered = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[tuple(t[i : i + size])] > 1:
                covered[i : i + size] = b"\1" * size
        out.append((d, sum(covered)))
    return sorted(out)


def test_query_counts_passages_below_400_bytes(spark, tmp_path):
    rng = random.Random(7)
    short = [w[:5] for w in words(rng, 60)]
    rows = [(d, " ".join(words(rng, 90)) + "\n" + "\n ".join(short[: 60 - 3 * d]) + ". " + " ".join(words(rng, 90))) for d in range(5)]  # the last word has a full stop: 59, 56, 53, 50 and 47 can be shared
    rows += [(d, " ".join(words(rng, 200))) for d in range(5, 9)] + [(9, None), (10, ""), (11, " ".join(short[:50]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in m.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(r["n_removed"] == 0 for r in got.values())
    assert {d: r["n_passage_words"] for d, r in got.items()} == {0: 56, 1: 56, 2: 53, **dict.fromkeys(range(3, 12), 0)}
    assert [(d, r["n_passage_words"]) for d, r in sorted(got.items())] == brute(rows, 51)


@pytest.mark.parametrize("group", [2, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, group):
    rng = random.Random(seed)
    shared = [words(rng, 90), words(rng, 30), ["la"] * 80, words(rng, 300), words(rng, 3) * 40]
    rows = []
    for d in range(60):
        parts = [rng.choice([words(rng, rng.randint(0, 80)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 50) :]]) for _ in range(rng.randint(0, 5))]
        rows.append((d, "".join(w + rng.choice([" ", "\n", "  \t"]) for p in parts for w in p)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "q" * 5000), (104, "é x " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = m.suffix_dedup(docs, 400, keep_first=False, group=group, passage=20).collect()
    assert sorted((r["doc_id"], r["n_passage_words"]) for r in got) == brute(rows, 20)


def test_words_over_segments():
    rng = random.Random(3)
    text, long = " ".join(words(rng, 60_000)).encode(), b"z" * m.SEGMENT
    for data in (text, long, long + b" a", b"a " + long, b"a " + long + b"z\nb " + long, text + b" " * m.SEGMENT + text, b" " * m.SEGMENT):
        found = WORD.findall(data)
        hashes = np.frombuffer(m.word_hashes(data), np.uint32).tolist()
        assert len(hashes) == len(found) and len(set(zip(found, hashes))) == len(set(found)) == len(set(hashes))
