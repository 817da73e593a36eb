import pytest
from pyspark.sql import functions as F

from stratapanel.llm import exact_dedup as m


def brute(rows):
    import hashlib
    import re

    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    out = []
    for d, t in norm:
        known = [x for x in groups[t] if x is not None]
        out.append((d, min(known, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "digest"), [(1024, F.xxhash64), (7, F.xxhash64), (16, lambda b: F.pmod(F.xxhash64(b), F.lit(13)))])
def test_edge_cases(edge, empty, block, digest):
    got = m.exact_dedup(edge, block, digest=digest).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    kept = {}
    for r in got:
        kept.setdefault(r["text_sha256"], []).append(r["kept"])
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert all(sum(k) == 1 for k in kept.values())
    assert m.exact_dedup(empty, block).collect() == []


def test_equals_sql_on_distinct_ids(spark, oracle):
    from tests.llm.conftest import same

    docs = spark.createDataFrame([(i, ("x y\n" * (i % 5)) + "z" * (i % 3) if i % 7 else None) for i in range(200)], "doc_id long, text string")
    same(m.exact_dedup(docs, 3).collect(), oracle(docs, m.ORACLE))


def test_collisions_never_merge_texts(spark):
    docs = spark.createDataFrame([(i, format(i, "b")) for i in range(300)], "doc_id long, text string")
    got = m.exact_dedup(docs, 2, digest=lambda b: F.lit(1).cast("long")).collect()
    assert all(r["group_size"] == 1 for r in got)


def test_names_do_not_depend_on_partitioning(spark):
    docs = spark.createDataFrame([(i, "ab cd " * (i % 9) + str(i % 40)) for i in range(400)], "doc_id long, text string")

    def names(rows, digest=F.xxhash64):
        return sorted((r["doc_id"], r["level"], r["name"]) for r in m.identities(rows, 4, digest=digest).select("doc_id", "level", "name").collect())

    few = lambda b: F.pmod(F.xxhash64(b), F.lit(5))
    for digest in (F.xxhash64, few):
        first = names(docs.repartition(1), digest)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            assert names(docs.repartition(5, "text"), digest) == first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
