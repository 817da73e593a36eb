import random
import re

import numpy as np
import pytest
import xxhash

from stratapanel.llm import simhash as m


def fingerprint(text, words):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("words", [1, 4, 5])
def test_fingerprint(words):
    for t in (None, "", " \n", "One", "a B c", "É é A a " * 50, "x y z w v " * 3, "\x1c a\xa0b \x85"):
        assert m.fingerprint(t, words) == fingerprint(t, words)


def clustered(seed, n, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            base ^= 1 << b
        out.append(base)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("radius", "bands"), [(4, 6), (3, 4), (6, 9), (0, 2)])
@pytest.mark.parametrize("tree", [8, 1024])
def test_links_connect_like_brute_force(spark, radius, bands, tree):
    fps = clustered(radius, 400, radius + 3)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps], "fp long").repartition(3)
    edges = m.links(nodes, radius, bands, tree)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 64  # a star's ends need not be neighbours
    got = {r["node"]: r["component"] for r in m.components(edges).collect()}
    expected = components(fps, radius)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    groups = {}
    for x, g in zip(signed, expected):
        groups.setdefault(g, []).append(x)
    for members in groups.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_tree_links_are_all_links():
    rng = np.random.default_rng(2)
    fp = (rng.integers(0, 1 << 63, 20, np.uint64)[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    group = np.sort(rng.integers(0, 4, 300))
    a, b = m.tree_links(group, fp, np.ones(300, np.int8), 4)
    got = {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != y}
    assert got == {(i, j) for i in range(300) for j in range(300) if i != j and group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in m.components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000


def test_edge_cases(spark, edge, empty):
    got = m.near_duplicates(edge).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    fps = [fingerprint(t, 4) for _, t in rows]
    groups = components(fps, 4)
    expected = []
    for (d, _), fp, g in zip(rows, fps, groups):
        ids = [x for (x, _), k in zip(rows, groups) if k == g and x is not None]
        expected.append((d, fp - (1 << 64) if fp >= 1 << 63 else fp, min(ids, default=None)))
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got), key=repr) == sorted(expected, key=repr)
    assert m.near_duplicates(empty).collect() == []
    one = m.one_of_each(edge, 4)
    assert one.columns == edge.columns and one.count() == len(set(groups))
    assert m.one_of_each(empty).collect() == []


def test_similar_texts_are_verified(spark):
    rng, rows, groups = random.Random(5), [], []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shingled = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for g in range(40):
        base = [word() for _ in range(120)]
        near, far = list(base), list(base)
        near[30] = near[80] = word()
        for i in range(5, 120, 15):
            far[i] = word()
        for kind, t in (("base", base), ("near", near), ("far", far)):
            similarity = len(shingled(base) & shingled(t)) / len(shingled(base) | shingled(t))
            assert similarity >= 0.8 if kind != "far" else similarity < 0.8
            rows.append((len(rows), " ".join(t)))
            groups.append((g, kind))
    rows += [(None, rows[0][1].upper()), (None, rows[0][1].upper()), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in m.one_of_similar(docs).collect()}
    assert {i for i, (_, kind) in enumerate(groups) if kind != "near"} | {500} <= kept  # nothing below 0.8 goes
    assert None not in kept and 501 not in kept and sum(i < 120 for i in kept) <= 80 + 4  # of 40 near copies 36 or more go
    fps = [fingerprint(t, 5) for _, t in rows[:120]]
    assert sum((fps[i] ^ fps[i + 1]).bit_count() <= 5 for i in range(0, 120, 3)) < 36  # what one fingerprint finds


def test_similar_large_group_in_blocks(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(0, i, 60, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(59)] + [(0, 99, 60, "another text")]
    members = spark.createDataFrame(rows, "key long, sh long, n long, text string").repartition(3)
    edges = m.verified(members, 5, 0.8, block=8)
    got = {r["node"]: r["component"] for r in m.components(edges).collect()}
    assert got == dict.fromkeys(range(59), 0)


def test_similar_long_texts_make_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "ROW_SHINGLES", 8)
    taken = []
    blocks = m._blocks
    monkeypatch.setattr(m, "_blocks", lambda members, block, *keep: taken.append((block, members)) or blocks(members, block, *keep))
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*base[: 200 * i], f"x{i}", *base[200 * i + 1 :]])) for i in range(1, 13)] + [(50, "another text"), (51, "another text"), (52, None)]
    found = m.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [list(range(1, 13)), [50, 51], [52]]
    members = [x for block, x in taken if block == m.BLOCK][0]
    assert {r["n"] for r in members.select("n").distinct().collect()} == {-(-12 * 2996 // 8)}  # 18 blocks for 12 texts
