import random

import duckdb
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, th long, fp long, words string, line string, key string, i int, n int, rid long, copies long, component long, n_lines long, level int, name string, bytes binary, s string, u long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(200)]
    return " ".join(rng.choices(vocabulary, k=words))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    changed = base.split()
    changed[60] = "changed"
    long = prose(2, 40_000)
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(changed), "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, "b"),
        (6, " \t\n ", "en", None),
        (7, "12345 !!! ...", "en", "c"),
        (8, long, "en", "c"),
        (9, long + " end", "de", "c"),
        (10, "é" * 30 + " ünï", "fr", None),
        (11, base.replace(" ", "  \n"), "en", "d"),
        (11, base, "en", "d"),  # an id twice, with another text
        (12, "repeated row", "en", "e"),
        (12, "repeated row", "en", "e"),
        (None, "no id at all", "en", "e"),
        (13, base + "\n" + base + "\nshort", "en", "a"),
        (14, "ab" * 700, "en", "b"),
        (15, "This is under the MIT License and the General Public License.", "en", "b"),
    ]
    return [(d, t, lang, src, None if t is None else len(t), 5, 6, 7, "w", "l", "k", 1, 2, 3, 4, 5, 6, 7, "n", b"b", "s", 9) for d, t, lang, src in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def oracle(tmp_path):
    """Rows of an SQL query over a DataFrame as the table documents."""

    def run(docs, sql: str) -> list[dict]:
        path = str(tmp_path / "documents.parquet")
        docs.write.mode("overwrite").parquet(path)
        with duckdb.connect() as db:
            db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
            rel = db.sql(sql)
            return [dict(zip(rel.columns, r)) for r in rel.fetchall()]

    return run


def same(got, expected, places: int = 6) -> None:
    """Equal as multisets of rows, whatever the order of columns."""
    form = lambda r: sorted((k, round(v, places) if isinstance(v, float) else v) for k, v in r.items())
    got = sorted((form(r.asDict()) for r in got), key=repr)
    expected = sorted((form(r) for r in expected), key=repr)
    assert got == expected
