"""Repeated ids of different texts give one result however rows are dealt; columns may have dots in their names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from stratapanel.llm import exact_dedup, language, licenses, line_dedup, media, mixing, packing, simhash, suffix_dedup, token_counts
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def ties(spark):
    """One id for texts of different lengths, another for different texts of one length, in one source."""
    rows = [(1, prose(k, 20 + 3 * k), "a") for k in range(10)] + [(2, " ".join(random.Random(k).choices("abcdefgh", k=30)), "a") for k in range(12)]
    rows += [(k, prose(k, 40), "b") for k in range(10, 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("make", [lambda d: packing.pack(d, 16, 3, 64), lambda d: packing.pack_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), 16, 3, 64), lambda d: mixing.repeat(d, mixing.mix(d)), lambda d: mixing.mix(d)])
def test_ties_whatever_the_partitioning(ties, make):
    seen = {tuple(sorted(map(repr, make(ties.repartition(n, *by)).collect()))) for n, by in ((1, ()), (3, ()), (4, ("text",)), (7, ("doc_id",)))}
    assert len(seen) == 1


def dotted(df):
    return df.select("*", F.lit(7).alias("meta.url"), F.lit(8).alias("a b.c"))


def test_kept_columns_with_dots(edge):
    docs = dotted(edge.select("doc_id", "text", "lang"))
    filters = language.fit(language.training(docs))
    out = language.identify(docs, filters, keep=("meta.url", "lang"), evidence=True)
    assert out.columns[:4] == ["doc_id", "meta.url", "lang", "lang_pred"] and {r["meta.url"] for r in out.collect()} == {7}
    plain = language.identify(edge, filters, keep=("lang",), evidence=True)
    assert sorted(map(repr, out.drop("meta.url").collect())) == sorted(map(repr, plain.collect()))
    pages = dotted(edge.select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html")))
    seen = media.interleave(pages, "doc_id", "html", ("meta.url",))
    assert seen.columns == ["doc_id", "meta.url", "items"] and {r["meta.url"] for r in seen.collect()} == {7}


OPERATORS = {
    "mix": mixing.mix,
    "suffix": lambda d: suffix_dedup.suffix_dedup(d),
    "store": media.store_texts,
    "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "exact": exact_dedup.exact_dedup,
    "pack": packing.pack,
    "licenses": lambda d: licenses.scan(d),
    "lines": line_dedup.line_dedup,
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_bear_columns_with_dots(edge, name):
    docs = dotted(edge.select("doc_id", "text", "source").where("text is null or length(text) < 5000"))
    assert OPERATORS[name](docs).count() >= docs.where("text is not null").select("text").distinct().count()


def test_stages_bear_columns_with_dots(spark, edge):
    docs = out = dotted(edge.select("doc_id", "text", "lang", "source", "n_chars").where("text is null or length(text) < 5000"))
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, out, "").cache()
        assert out.columns == docs.columns and {r["meta.url"] for r in out.collect()} == {7}
    assert c.STAGES[-1][1](spark, out, "").count() >= out.count()
