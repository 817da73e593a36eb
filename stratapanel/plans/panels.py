"""The panels that the registered queries work on, in Spark and as SQL for comparison.

monthly: order value by nation and month; dense.  daily: purchase value by user and
day; dense and mostly zero.  Money is summed as decimals, so that sums don't depend
on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions import calendar
from stratapanel.functions.elementary import asinh
from stratapanel.operators import panel as P
from stratapanel.spec import PanelSpec, Partition

MONTHLY = PanelSpec("month_id", "nation", ("y",), ("n",))
DAILY = PanelSpec("day_id", "user_id", ("y",), ("n",))
#: Months 181 to 236 train, 237 to 260 test; 12 inputs, 12 outputs, so 13 origins.
PARTITION, INPUTS, STEPS = Partition((181, 236), (237, 260)), 12, 12
#: The days of January 2024 that train and test the daily panel.
DAYS = Partition((16072, 16095), (16096, 16101))
#: Length of the daily loss series.
LOSS_STEPS = 24
THRESHOLD = 0.5


def money(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return P.aggregate_panel(rows, calendar.month_id(F.col("o_orderdate")), F.col("c_nationkey"), {"y": money("o_totalprice"), "n": F.count("*")}, MONTHLY)


def _span(rows: DataFrame, time: Column, parts: Partition) -> DataFrame:
    """One row: from the first to the last time of partitions and rows."""
    first, last = F.min(time), F.max(time)
    return rows.agg(F.least(first, F.lit(parts.train[0])), F.greatest(last, F.lit(parts.test[1])))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    sparse = monthly_sparse(spark, sf_dir)
    span = _span(table(spark, sf_dir, "orders"), calendar.month_id(F.col("o_orderdate")), PARTITION)
    return P.densify(sparse, nations, MONTHLY, span=span)


def daily_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return P.aggregate_panel(events, calendar.day_id(F.col("ts")), F.col("user_id"), {"y": money("value"), "n": F.count("*")}, DAILY)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    span = _span(table(spark, sf_dir, "events").where("event_type = 'purchase'"), calendar.day_id(F.col("ts")), DAYS)
    return P.densify(daily_sparse(spark, sf_dir), users, DAILY, span=span)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, k, p, y): the last 24 days of each user, truths and predictions in asinh space.

    The prediction is half the value six days before, plus a tenth.
    """
    lagged = P.positions(daily(spark, sf_dir), DAILY)
    z = lagged.withColumn("y", asinh(F.col("y")))
    from stratapanel.operators.forecast import lagged as shift

    rows = shift(z, DAILY, "y", 6)
    return rows.select(F.col("user_id").alias("s"), (F.col("position") - 6).alias("k"), (0.5 * F.col("prediction") + 0.1).alias("p"), "y")


PM_SPARSE = """pms AS (
  SELECT ((year(o_orderdate) - 1980) * 12 + month(o_orderdate))::INTEGER AS month_id, c_nationkey AS nation,
         sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
SPAN = "SELECT unnest(range(least(coalesce(min({0}), {2}), {2}), greatest(coalesce(max({0}), {3}), {3}) + 1)) AS {0} FROM {1}"
PM = f"""{PM_SPARSE}, pm AS (
  SELECT c.month_id::INTEGER AS month_id, c.nation, coalesce(y, 0)::DOUBLE AS y, coalesce(n, 0)::BIGINT AS n
  FROM (SELECT n_nationkey AS nation, month_id FROM nation, ({SPAN.format("month_id", "pms", PARTITION.train[0], PARTITION.test[1])})) c
  LEFT JOIN pms USING (month_id, nation))"""
PD_SPARSE = """pds AS (
  SELECT (datediff('day', DATE '1980-01-01', ts::DATE) + 1)::INTEGER AS day_id, user_id,
         sum(value::DECIMAL(18,2))::DOUBLE AS y, count(*) AS n
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"""
PD = f"""{PD_SPARSE}, pd AS (
  SELECT c.day_id::INTEGER AS day_id, c.user_id, coalesce(y, 0)::DOUBLE AS y, coalesce(n, 0)::BIGINT AS n
  FROM (SELECT user_id, day_id FROM (SELECT DISTINCT user_id FROM events), ({SPAN.format("day_id", "pds", DAYS.train[0], DAYS.test[1])})) c
  LEFT JOIN pds USING (day_id, user_id))"""
ASINH = "(sign({0}) * ln(abs({0}) + sqrt({0} * {0} + 1)))"
PAIRS = f"""{PD}, pz AS (
  SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY day_id) - 1 AS pos, {ASINH.format("y")} AS y FROM pd
), pl AS (
  SELECT s, pos - 6 AS k, 0.5::DOUBLE * lag(y, 6) OVER (PARTITION BY s ORDER BY pos) + 0.1::DOUBLE AS p, y FROM pz
), pr AS (SELECT s, k, p, y, p - y AS e FROM pl WHERE p IS NOT NULL)"""
