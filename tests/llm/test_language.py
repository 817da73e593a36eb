import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import language


def test_no_false_negatives_and_correction():
    rng = np.random.default_rng(1)
    sets = {x: rng.integers(1, 1 << 62, 3000, np.uint64) for x in ("aa", "bb", "cc")}
    f = language.Filters(["aa", "bb", "cc"], sets)
    for k, x in enumerate(f.languages):
        assert ((f.masks(sets[x])[:, 0] >> k) & 1).all()
    other = rng.integers(1, 1 << 62, 200_000, np.uint64)
    assert ((f.masks(other)[:, 0] & 1).mean()) == pytest.approx(f.false[0], abs=2e-4)


def test_many_languages():
    names = [f"l{i:03d}" for i in range(70)]
    sets = {x: np.arange(1 + 100 * i, 100 + 100 * i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i, x in enumerate(names)}
    f = language.Filters(names, sets)
    assert f.cells.shape[1] == 2
    assert ((f.masks(sets["l069"])[:, 1] >> np.uint64(5)) & np.uint64(1)).all()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy(spark):
    out = language.op2_language(spark, "/root/testdata/sf0.01")
    docs = language.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert out.where("score < 0 or score > 1 or score is null").isEmpty()


def test_edge_cases(spark, edge, empty):
    filters = language.fit(language.training(edge))
    got = language.identify(edge, filters, keep=("source", "text")).collect()
    assert len(got) == edge.count()
    for r in got:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered)
        assert 0 <= r["score"] <= 1 and (lettered or r["score"] == 0)
    none = language.fit(language.training(empty))
    assert none.languages == [] and {r["lang_pred"] for r in language.identify(edge, none).collect()} == {"und"}
    assert language.identify(empty, filters).collect() == []


def test_long_texts_count_like_short_ones():
    text = "the quick brown fox " * 60_000
    runs = list(language.pieces([text]))
    whole = sum(len(language.grams(c, 4)[language.grams(c, 4) != 0]) for c, _ in runs)
    assert len(runs) > 1 and abs(whole - len(text)) < 10 * len(runs)


def brute_counts(text, sets, false):
    """Corrected hits of one text by language, n-gram by n-gram."""
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    clean = " " + " ".join(clean.split()) + " "
    hits = dict.fromkeys(sets, 0.0)
    total = 0
    for order in language.ORDERS:
        for i in range(len(clean) + 1):
            piece = (clean + "    ")[i : i + order]
            if piece.strip() and i < len(clean):
                total += 1
                h = language.grams(np.frombuffer(piece.encode("utf-32-le"), np.uint32), order)[0]
                for x in sets:
                    hits[x] += h in sets[x]
    return {x: max(0.0, (hits[x] - total * false[x]) / (1 - false[x])) for x in sets}


def test_predictions_against_sets_without_filters():
    import random

    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 6)))
    alphabets = {"aa": "abcdefghij", "bb": "fghijklmno", "cc": "klmnopqrst"}
    train = {x: " ".join(word(a) for _ in range(2000)) for x, a in alphabets.items()}
    sets = {}
    for x, t in train.items():
        (chars, _), *_ = language.pieces([t])
        sets[x] = np.unique(np.concatenate([language.grams(chars, o) for o in language.ORDERS]))
        sets[x] = sets[x][sets[x] != 0]
    f = language.Filters(list(sets), sets)
    texts = [" ".join(word(alphabets[rng.choice(list(sets))]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a", "F1 o.O"]
    names, scores, *_ = f.judge(texts)
    held = {x: set(s.tolist()) for x, s in sets.items()}
    for text, name, score in zip(texts, names, scores):
        real = brute_counts(text, held, dict(zip(sets, f.false)))
        best = max(sets, key=lambda x: (real[x], -list(sets).index(x)))
        part = real[best] / sum(real.values()) if sum(real.values()) else 0.0
        assert score == pytest.approx(part, abs=0.03) and (name == best or real[best] - real[name] < 2)


def test_clashing_names(spark, edge):
    filters = language.fit(language.training(edge))
    docs = edge.select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("_text"), F.lit(2.0).alias("rate"), F.array(F.struct(F.lit(1).alias("odd name"))).alias("lang_pred"))
    out = language.identify(docs, filters, keep=("score", "_text", "rate", "lang_pred", "text"), evidence=True)
    assert out.columns == ["doc_id", "score", "_text", "rate", "lang_pred", "text", "pred_lang_pred", "pred_score", "pred_rate", "lead", "grams"]
    assert {r["score"] for r in out.collect()} == {1}
