import random

import numpy as np
import pytest

from stratapanel.llm import minhash as m

from tests.llm.conftest import prose


def shingle_set(text, words):
    tokens = (text or "").encode().lower().split()
    size = min(words, len(tokens))
    return {b" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if tokens else set()


def brute(rows, words=4, percent=80):
    sets = [shingle_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), d), d)
    named = [low.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, named)), key=repr)


def rows_of(found):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()), key=repr)


def changed(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def test_equals_brute_force(spark):
    """Copies at all distances, short texts, chains, and copies that are nearer to their original than to each other."""
    rows = []
    for g in range(12):
        base = prose(100 + g, random.Random(g).choice([8, 20, 60, 200, 900]))
        rows += [base, base.upper()] + [changed(base, n, g * 50 + n) for n in range(1, max(2, len(base.split()) // 16))]
    hub = prose(7, 300)
    rows += [hub, *(changed(hub, 7, 1000 + i) for i in range(60))]
    chain = prose(8, 200).split()
    rows += [" ".join(chain[k : k + 120]) for k in range(0, 60, 10)]
    rows += ["one", "one", "one two", "one two three", "one two three four", "a b c d e f g h", "a b c d e f g h i", "x y z " * 30, "x y z " * 40]
    rows = [(i, t) for i, t in enumerate(rows)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(m.near_duplicates(docs, 4)) == brute(rows)


def test_links_between_rays(spark, monkeypatch):
    """Small blocks; stars whose centres aren't linked to the rest."""
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 2_000)
    monkeypatch.setattr(m, "RAYS", 3)
    base = prose(3, 150).split()
    rows = [(i, " ".join(base[i : i + 100] + [f"end{i // 2}"] * 5)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(m.near_duplicates(docs, 4)) == brute(rows)


def test_missed_links_are_found_without_the_star(spark):
    """A centre that no ray is linked to: its rays are still compared with each other."""
    rng = np.random.default_rng(0)
    pool = rng.integers(-(2**62), 2**62, 400)
    near = {k: np.sort(np.append(pool[:100], pool[200 + 4 * k : 204 + 4 * k])) for k in range(1, 30)}
    sets = [(0, np.sort(pool[50:150])), *near.items(), (40, np.sort(pool[100:200]))]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in sets], "sh long, ids array<long>")
    rays = spark.createDataFrame([(9, 0, k, len(v)) for k, v in sets[1:]], "key long, centre long, sh long, size long")
    pairs = m.missed(rays, spark.createDataFrame([], "centre long, sh long"), table, 80).collect()
    assert {x for p in pairs for x in p} == set(near)


def test_recall_at_the_threshold():
    """Pairs at a similarity of 0.80 to 0.82, of all sizes, share a bucket."""
    rng, found, total = np.random.default_rng(6), 0, 0
    for size in (5, 6, 10, 18, 45, 90, 200, 450, 1_000, 5_000):
        for _ in range(300):
            union = rng.integers(0, 2**64, size, np.uint64)
            out = size // 5
            a, b = np.sort(union[out // 2 :]), np.sort(union[: size - out + out // 2])
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 80 * size
            total += 1
            found += bool((m.bucket_keys(a) == m.bucket_keys(b)).any())
    assert found >= total - 2


def test_densified_bins_agree_as_sets_do():
    rng = np.random.default_rng(3)
    union = rng.integers(0, 2**64, 60, np.uint64)
    same = [(m.sketch(np.sort(u[:50])) == m.sketch(np.sort(u[10:]))).mean() for u in (rng.permutation(rng.integers(0, 2**64, 60, np.uint64)) for _ in range(400))]
    assert abs(np.mean(same) - 40 / 60) < 0.02 and len(m.sketch(np.sort(union)[:1])) == 160


def test_edge_rows(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = rows_of(m.near_duplicates(edge, 4))
    assert [r[:3] for r in got] == [r[:3] for r in brute(rows)]
    assert all(r[3] == (r[0] == r[2]) for r in got)
    assert m.near_duplicates(empty).collect() == []
    odd = edge.withColumn("meta.url", edge["size"]).withColumn("sh", edge["size"]).withColumn("ids", edge["size"])
    assert rows_of(m.near_duplicates(odd, 4)) == got


def test_less_than_the_bands_find_is_refused(spark, empty):
    with pytest.raises(ValueError, match="80"):
        m.near_duplicates(empty, percent=70)
