from stratapanel.llm import licenses as m
from tests.llm.conftest import same


def test_edge_cases_equal_sql(edge, empty, oracle):
    same(m.scan(edge).drop("spans").collect(), oracle(edge, m._oracle()))
    assert m.scan(empty).collect() == []


def test_base_places(spark):
    text = "MIT License, mit-license; the Apache LICENSE: general public license general public general public license mit licenses"
    r = m.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (17, 5, 0, 12, "apache,gpl,mit", 1.0)


def test_neighbouring_diagonals_merge(spark, oracle):
    notice = "Redistribution and use in source and binary forms, with or without modification, are kindly permitted provided that the following conditions are met"
    unrelated = "with or without you are permitted"
    triples = m.TEMPLATES[3][2].split()
    scattered = " ".join(" ".join(triples[i : i + 3]) + " foreign words" for i in range(0, len(triples), 3))
    docs = spark.createDataFrame([(1, "x y " + notice), (2, unrelated), (3, notice.replace("source and binary", "all")), (4, scattered)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.scan(docs).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["n_base"] == 0 and got[1]["score"] == 1
    assert [(s["start"], s["end"], s["label"]) for s in got[1]["spans"]] == [(2, 24, "bsd")]
    assert got[2]["labels"] == "" and got[2]["score"] == 0 and got[3]["labels"] == "bsd" and 0.8 < got[3]["score"] < 1
    assert got[4]["labels"] == ""
    same(m.scan(docs).drop("spans").collect(), oracle(docs, m._oracle()))


def test_full_texts_of_any_length(spark, oracle):
    texts = [t for _, base, t in m.TEMPLATES if not base]
    long = " ".join(f"w{i}" for i in range(500))
    rows = [(i, f"Some code. {t} The end.") for i, t in enumerate(texts)] + [(99, long)]
    found = m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    labels = {r["doc_id"]: r["labels"].split(",") for r in found}
    assert all(label in labels[i] for i, label in enumerate(x for x, base, _ in m.TEMPLATES if not base)) and labels[99] == [""]
    own = m.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("own", False, long)]).collect()
    assert {r["doc_id"] for r in own if r["labels"] == "own"} == {99} and max(r["score"] for r in own) == 1
    same(m.scan(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect(), oracle(spark.createDataFrame(rows, "doc_id long, text string"), m._oracle()))


def test_only_ascii_is_lowered(spark):
    rows = [(1, "MIT L\u0130CENSE"), (2, "wor\u212a MIT License"), (3, "\u212a"), (4, "\u00c9t\u00c9 mit license")]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"]) for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 0, None), 2: (3, 1, 1), 3: (1, 0, None), 4: (3, 1, 1)}


def test_brute_force_base(spark):
    import random
    import re
    import string

    rng = random.Random(4)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    vocabulary = ["mit", "license", "apache", "general", "public", "x", "é", "LICENSE", "Mit"]
    rows = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(150)]
    phrases = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
    for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[r["doc_id"]][1].translate(lower))
        places = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
