import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stratapanel.llm import token_links as m

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return m.Sides(A, B)


def decoded(entry: str) -> bytes:
    """Bytes of a byte-level entry: printable characters stand for themselves, the others for the rest in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return bytes(table[c] for c in entry)


def brute(rows, rule="ends"):
    """Token by token, with sets and loops."""
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        x = [decoded(a_lib.id_to_token(i)) for i in a]
        y = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(x) == b"".join(y) == (" " + text).encode():
            a, b, x, y = [], [], [], []
        ends = [[sum(map(len, z[: k + 1])) for k in range(len(z))] for z in (x, y)]
        common = sorted(set(ends[0]) & set(ends[1]))
        group = [[sum(c < e for c in common) for e in z] for z in ends]
        if rule == "ends":
            links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in common]
        else:
            links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if group[0][i] == group[1][j]]
        text_of = ";".join("|".join(",".join(str(t) for t, g in zip(ids, gs) if g == k) for ids, gs in zip((a, b), group)) for k in range(len(common)))
        counts.update(links)
        docs.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((d, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), s) for d, na, nb, ng, links, s in docs), key=repr)


ODD = ["a<|endoftext|> b </s> <unk> <0x0A>", "tab\tand\nlines\r\n", "  two  spaces ", "▁ is not kept", "naïve café über 日本語 🙂🙂", "x", "ﬁ ligature ½ Å", "\u0000nul nbsp", "don't I'll we've 12345 67.89", "words " * 40]


def rows_of(found):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)


@pytest.mark.parametrize("rule", ["ends", "groups"])
def test_equals_brute_force(spark, rule):
    rng = random.Random(5)
    texts = [*ODD, None, "", *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), 32, 32])) for _ in range(80)) for _ in range(30))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "the same id"), (None, "words words"), (None, "words words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(m.align(docs, A, B, rule)) == brute(rows, rule)


def test_edge_rows_and_shuffled_counts(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    docs = edge.where("text is null or length(text) < 20000")
    expected = brute(rows)
    assert rows_of(m.align(docs, A, B)) == expected
    assert rows_of(m.align(docs, A, B, sent_pairs=0)) == expected  # counts too many to be sent to all tasks
    assert m.align(empty, A, B).collect() == []


def test_columns_with_odd_names(spark):
    docs = spark.createDataFrame([(1, "some words here", 5, 6)], "doc_id long, text string, `meta.url` int, pair int")
    assert rows_of(m.align(docs, A, B)) == brute([(1, "some words here")])


def test_parts_of_long_texts(sides, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdé 1.,\n-", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(5)]
    whole = [sides.tokens(t) for t in texts]
    monkeypatch.setattr(m, "PART_CHARS", 50)
    assert all(len(list(m.parts(t))) > 5 for t in texts)
    assert all((x == y).all() for w, t in zip(whole, texts) for x, y in zip(w, sides.tokens(t), strict=True))
    assert list(m.parts("x" * 500)) == ["x" * 500]


def test_ranks_give_the_ids_of_the_library(sides, monkeypatch):
    """All code points beside letters, digits, marks and spaces (every 37th here; a full pass found no difference), and long repeats."""
    assert sides.by_ranks is not None
    points = [chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [" " + "".join(f"a{c}b {c}{c} 1{c} .{c}!  {c} x" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += [" " + x * 3000 for x in ("a", "ab", " ", ".", "é", " \n", "'s", "<|endoftext|>")]
    fast = [sides.a(t) for t in texts]
    monkeypatch.setattr(m, "PART_CHARS", 0)
    assert fast == [sides.a(t) for t in texts]


def test_pieces_never_join_over_a_space(sides):
    """What the parts rely on: no piece holds a space after another character."""
    assert not [p for p in sides.b_bytes if b" " in p.lstrip(b" ")]


def test_pairs_that_end_together_are_bounded(sides, spark, edge):
    facts = m.linked(edge, A, B)
    for (pair,) in m.pair_counts(facts, len(sides.b_bytes)).select("pair").collect():
        a, b = sides.a_bytes[pair // len(sides.b_bytes)], sides.b_bytes[pair % len(sides.b_bytes)]
        assert a.endswith(b) or b.endswith(a)
    assert sides.pairs_bound < 1_000_000


def test_groups_give_the_text_again(spark, sides):
    rows = [(1, "naïve café über"), (2, None), (3, "▁ goes"), (4, "plain words here")]
    got = m.token_groups(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    for doc_id, text in rows:
        groups = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["number"])
        joined = [b"".join(table[i] for r in groups for i in r[c]) for table, c in ((sides.a_bytes, "a_ids"), (sides.b_bytes, "b_ids"))]
        data = b"" if text is None or "▁" in text else (" " + text).encode()
        assert joined == [data, data]
        assert all(b"".join(sides.a_bytes[i] for i in r["a_ids"]) == data[r["start"] : r["stop"]] for r in groups)
