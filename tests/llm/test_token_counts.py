import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratapanel.llm import token_counts as m

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return m.Counter(PATH)


def test_equals_library(library, counter):
    rng = random.Random(0)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(9, 34), rng.randrange(0x1F000, 0x1FAFF), 32, 32]))
    texts = ["", " ", "a<|endoftext|> b  <|endoftext|>\n x", "<|endoftext|><|endoftext|>", "  a  b\x1c\x85y  z  ", "a" * 5000, "ß" * 3000, "don't I'LL we've", *("".join(pick() for _ in range(60)) for _ in range(1500))]
    assert [counter(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_lazy_path(counter, monkeypatch):
    text = "some words <|endoftext|> and   more\n\n" * 50
    whole = counter(text)
    monkeypatch.setattr(m, "LAZY_CHARS", 10)
    assert counter(text) == whole


def naive(symbols, ranks):
    symbols = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
        if best is None:
            return len(symbols)
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_heap_equals_naive_merging():
    rng = random.Random(3)
    for _ in range(300):
        parts, ranks = list("abc"), {}
        for k in range(12):
            pair = (rng.choice(parts), rng.choice(parts))
            if pair not in ranks:
                ranks[pair] = k
                parts.append("".join(pair))
        s = rng.choices("abc", k=rng.randint(0, 30))
        assert m.merge_count(s, ranks) == naive(s, ranks)


def test_memory_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(m, "MEMO_PIECES", 50)
    fresh = m.PieceCounts(counter.pieces.ranks)
    for i in range(500):
        fresh[f"w{i}"]
    fresh["x" * 1000]
    assert len(fresh) <= 50 and "x" * 1000 not in fresh


def test_query_rows(edge, empty, library):
    got = m.count_tokens(edge, PATH).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in edge.select("doc_id", "text").collect()]
    expected = []
    for d, t in rows:
        n = len(library.encode(t, add_special_tokens=False).ids)
        expected.append((d, len(t.encode()), n, n > 1024))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert m.count_tokens(empty, PATH).collect() == []
