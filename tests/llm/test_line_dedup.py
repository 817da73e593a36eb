import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import line_dedup as m


def distance_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    """rows of (doc_id, text) with distinct ids: the text that stays of each, and how many lines went as near copies."""
    lines = [(d, k, line, line.lower().split()) for d, t in sorted(rows) for k, line in enumerate((t or "").split("\n"))]
    times = Counter(tuple(words) for _, _, _, words in lines)
    first, kept, near = {}, {d: [] for d, _ in rows}, dict.fromkeys((d for d, _ in rows), 0)
    for d, _, line, words in lines:
        key = tuple(words)
        if not words or (len(words) < m.MIN_WORDS and times[key] < m.SHORT_TIMES):
            kept[d].append(line)
        elif key in first:
            continue
        else:
            gone = len(words) >= m.NEAR_WORDS and any(len(o) >= m.NEAR_WORDS and distance_one(words, list(o)) for o in first)
            first[key] = True
            near[d] += gone
            if not gone:
                kept[d].append(line)
    return {d: ("\n".join(kept[d]), near[d]) for d, _ in rows}


def random_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    lines = [rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 6, 7, 9, 10, 11, 12, 16, 17, 25])) for _ in range(25)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(max(1, len(line)))
                line[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [*line[i : i + 1], rng.choice(vocabulary)]])
            out.append(rng.choice([" ", "  "]).join(line).capitalize())
        rows.append((d, "\n".join(out)))
    return [*rows, (98, "same same " * 6), (99, "same same " * 5 + "same")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, oracle, seed):
    rows = random_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["n_near"]) for r in m.line_dedup(docs).collect()}
    assert got == brute(rows)
    assert sum(n for _, n in got.values()) > 5
    assert {r["doc_id"]: r["n_removed"] for r in m.line_dedup(docs).collect()} == {r["doc_id"]: r["n_removed"] for r in oracle(docs, m.ORACLE)}


def test_edge_cases(edge, empty):
    out = m.line_dedup(edge)
    assert set(out.columns) == {*edge.columns, "lines_n_lines", "n_removed", "n_near"}  # a column n_lines is there already
    assert {r["n_lines"] for r in out.collect()} == {r["n_lines"] for r in edge.collect()}
    rows = out.select("doc_id", "text", F.col("lines_n_lines").alias("n_lines"), "n_removed").collect()
    assert len(rows) == edge.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[4][0]["text"] is None and by_id[4][0]["n_lines"] == 1
    assert by_id[1][0]["n_removed"] == 0 and by_id[2][0]["text"] == "" and by_id[2][0]["n_removed"] == 1
    assert by_id[3][0]["n_removed"] == 1  # one word changed
    assert by_id[13][0]["text"] == "short"
    assert [r["text"] for r in by_id[12]] == ["repeated row"] * 2
    assert m.line_dedup(empty).collect() == []


def test_long_lines(spark):
    words = [f"w{i}" for i in range(20_000)]
    changed = words[:9999] + ["other"] + words[10_000:]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(changed[:5] + changed[6:]))]
    got = {r["doc_id"]: r["n_near"] for r in m.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_repeated_rows_keep_first_copy(spark):
    line = " ".join(f"w{i}" for i in range(10))
    half = " ".join([f"w{i}" for i in range(5)] + [f"v{i}" for i in range(5)])  # shares a half, not near
    close = " ".join([f"w{i}" for i in range(9)] + ["other"])
    rows = [(1, line), (1, line), (2, half), (3, close), (None, half + " x y z"), (None, half + " x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_near"]) for r in m.line_dedup(docs).collect()))
    assert got == [(False, 1, line, 0)] * 2 + [(False, 2, half, 0), (False, 3, "", 1)] + [(True, 0, half + " x y z", 0)] * 2
