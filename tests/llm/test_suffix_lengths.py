"""The contract's length decides what goes, not a number of words: 400 bytes that start anywhere else."""

import random

import pytest

from stratapanel.llm import suffix_dedup as m


def words(rng, n_bytes):
    out = ""
    while len(out) < n_bytes:
        out += "".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) + " "
    return out[: n_bytes - 1] + "."


@pytest.mark.parametrize("n_bytes", [300, 399, 400, 450])
def test_passage_of_over_50_words(spark, n_bytes):
    rng = random.Random(n_bytes)
    passage = words(rng, n_bytes)
    assert len(passage) == n_bytes and len(passage.split()) > 50
    # what stands beside the passage differs, so nothing longer repeats
    rows = [(d, f"{words(rng, 900)}{chr(65 + d)}{passage}{chr(75 + d)}{words(rng, 900)}") for d in range(6)] + [(d, words(rng, 2000)) for d in range(6, 12)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in m.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False).collect()}
    gone = (n_bytes, 1) if n_bytes >= m.MIN_BYTES else (0, 0)
    assert got == {d: (len(t), *(gone if d < 6 else (0, 0))) for d, t in rows}
