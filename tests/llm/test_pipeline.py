import os
import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as c
from stratapanel.llm import language, line_dedup, mixing, packing

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_stages_against_brute_force(spark, oracle, tmp_path):
    docs = language.documents(spark, SF)
    held = [docs]
    for name, stage in c.STAGES:
        stage(spark, held[-1], SF).write.parquet(str(tmp_path / name))
        held.append(spark.read.parquet(str(tmp_path / name)))
        if name != "pack":
            assert held[-1].dtypes == docs.dtypes
    raw, spoken, lines, single, mixed, packed = held
    lettered = raw.where(F.col("text").rlike(r"\p{L}"))
    assert spoken.count() == lettered.count() == raw.count()
    expected = {r["doc_id"]: r for r in oracle(spoken, line_dedup.ORACLE)}
    kept = {r["doc_id"]: r["sha"] for r in lines.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    assert all(expected[d]["kept_sha256"] == sha for d, sha in kept.items())
    blank = {r["doc_id"] for r in line_dedup.line_dedup(spoken).where("trim(text) = ''").collect()}
    assert set(expected) - set(kept) == blank
    rows = lines.orderBy("doc_id").collect()
    groups = similar_pairs([r["text"] for r in rows], c.SHINGLE, c.SIMILAR)
    first = {}
    for r, g in zip(rows, groups):
        first.setdefault(g, r["doc_id"])
    assert {r["doc_id"] for r in single.collect()} == set(first.values())
    copies = {r["doc_id"]: r["copies"] for r in oracle(single, mixing.ORACLE) if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    rows = packed.collect()
    ids = Tokenizer.from_file(public_tokenizers.path(c.TOKENIZER))
    assert all(r["length"] == len(ids.encode(r["text"], add_special_tokens=False).ids) and r["padding"] == r["bucket_length"] - r["length"] >= 0 for r in rows)
    rebuilt, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        rebuilt[r["doc_id"], r["piece"]].append(r["text"])
        batches[r["bucket"], r["batch"]].append(r)
    for r in single.collect():
        assert "".join(rebuilt[r["doc_id"], k][0] for k in range(len([1 for d, _ in rebuilt if d == r["doc_id"]]))) == (r["text"] if r["doc_id"] in copies else "")
    assert all(len(x) == copies[d] for (d, _), x in rebuilt.items())
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0]["bucket_length"] <= packing.BUDGET) for b in batches.values())
    lengths = sorted({r["length"] for r in rows})
    counts = [sum(r["length"] == n for r in rows) for n in lengths]
    assert sorted({r["bucket_length"] for r in rows}) == packing.optimal_boundaries(lengths, counts, packing.BUCKETS)
    plain = lambda df: sorted(map(repr, df.drop("slot", "batch").collect()))
    assert plain(c.run(spark, SF)) == plain(packed)


def similar_pairs(texts, words, least):
    """Components of the exact similarity graph, as the first index of each text's component."""
    sets = []
    for t in texts:
        w = t.lower().split()
        size = min(words, len(w))
        sets.append({" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_edge_cases(spark, edge, empty):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, empty.select(docs.columns)):
        out = start
        for _, stage in c.STAGES:
            out = stage(spark, out, "").cache()
            out.count()
    rejected = c.identify_language(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in rejected.collect()} == {4, 5, 6, 7}


def test_clashing_names(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(1).alias(x) for x in ("score", "lang_pred", "rate", "grams", "n_lines", "n_removed", "th", "component", "copies", "size", "_text", "__mix")))
    out = docs
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, out, "").cache()
        assert out.columns == docs.columns and {r["score"] for r in out.collect()} == {1}
    assert c.STAGES[-1][1](spark, out, "").count() >= out.count()


def speech(seed, vocabulary, words=150):
    return " ".join(random.Random(seed).choices(vocabulary, k=words))


@pytest.mark.parametrize("languages", [2, 6])
def test_language_evidence_whatever_the_number(spark, languages):
    rng = random.Random(0)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    common = [word("abcdefghijklm") for _ in range(60)]  # related languages: most words are shared
    rows = []
    for k in range(languages):
        own = common + [word("abcdefghijklm") for _ in range(10)]
        rows += [(100 * k + i, speech(100 * k + i, own), f"l{k}") for i in range(30)]
    noise = speech(1, [word("nopqrstuvwxyz") for _ in range(140)] + common[:8])  # some hits, no language
    rows += [(9001, noise, None), (9002, "tiny zzz", None), (9003, "123", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in c.identify_language(spark, docs, "").collect()}
    assert got == {r[0] for r in rows} - {9001, 9003}


def test_no_labels_at_all(spark):
    rows = [(1, "some words", None), (2, "andere Wörter", None), (3, "12 !", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang"]) for r in c.identify_language(spark, docs, "").collect()} == {(1, None), (2, None)}
