import glob
import os
from datetime import date

import duckdb
import pytest

import __spark_entry__ as e
from stratapanel.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as c:
        for f in glob.glob(f"{SF}/*.parquet"):
            c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        yield c


def form(row: dict) -> list:
    def value(v):
        return round(float(v), 6) + 0.0 if isinstance(v, float) else v.isoformat() if isinstance(v, date) else v

    return sorted((k, value(v)) for k, v in row.items())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    got = sorted((form(r.asDict()) for r in catalog.QUERIES[name](spark, SF).collect()), key=repr)
    rel = db.sql(catalog.ORACLES[name])
    expected = sorted((form(dict(zip(rel.columns, r))) for r in rel.fetchall()), key=repr)
    assert got == expected and got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_optional_parts_may_be_absent(monkeypatch):
    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(e, "import_module", missing)
    assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)
