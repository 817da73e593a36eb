import duckdb
from pyspark.sql import functions as F

from stratapanel.functions.elementary import number_text
from stratapanel.plans import catalog

VALUES = [0.0, -0.0, 1.0, -12.5, 0.1 + 0.2, 1e-3, 1.2345e-4, 1e-4, 9.99e-5, 1e-5, -1.5e-300, 9999999.99, 1e7, 12345678.9, -13899015.66, 987654321012.34, 1e15, 9999999999999998.0, 1e16, -1.5e22, 1e100, 2.0e-3, 9.007199254740993e15, float("inf"), float("-inf"), float("nan"), None]


def test_numbers_as_sql_writes_them(spark):
    got = spark.createDataFrame([(v,) for v in VALUES], "v double").select(number_text(F.col("v"))).collect()
    with duckdb.connect() as db:
        expected = [db.execute("SELECT ?::DOUBLE::VARCHAR", [v]).fetchone()[0] for v in VALUES]
    assert [r[0] for r in got] == expected


def test_series_arrays_of_large_sums(spark, tmp_path):
    """Sums from 10,000,000 on, where a cast to string turns to exponents."""
    with duckdb.connect() as db:
        for name, sql in {
            "nation": "SELECT n::INTEGER AS n_nationkey FROM range(3) r(n)",
            "customer": "SELECT c AS c_custkey, (c % 3)::INTEGER AS c_nationkey FROM range(10) r(c)",
            "orders": "SELECT o AS o_orderkey, o % 10 AS o_custkey, DATE '1995-01-01' + (o * 7 % 2000)::INTEGER AS o_orderdate, round(exp(o % 20) * 100.37, 2) AS o_totalprice FROM range(900) r(o)",
        }.items():
            db.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        expected = sorted(db.sql(catalog.ORACLES["series_arrays"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["series_arrays"](spark, str(tmp_path)).collect()))
    assert got == expected and max(float(v) for v in got[0][2][1:-1].split(", ")) > 1e10
