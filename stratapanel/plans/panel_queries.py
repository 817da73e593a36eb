"""Panels, audits, calendars, fingerprints and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.functions import calendar
from stratapanel.functions.elementary import number_text
from stratapanel.operators import audit, fingerprint, panel, windows
from stratapanel.operators import forecast as fc
from stratapanel.plans.panels import ASINH, DAILY, DAYS, INPUTS, MONTHLY, PARTITION, PD, PD_SPARSE, PM, PM_SPARSE, STEPS, THRESHOLD, daily, daily_sparse, monthly, monthly_sparse, table
from stratapanel.plans.registry import query, rounded

SEQUENCES = PARTITION.origins(STEPS)
T0, T1 = PARTITION.train
S0, S1 = PARTITION.test


@query("panel_monthly", f"WITH {PM} SELECT month_id, nation, y, n FROM pm")
def panel_monthly(spark, d):
    return monthly(spark, d)


@query("panel_daily", f"WITH {PD} SELECT day_id, user_id, y, n FROM pd")
def panel_daily(spark, d):
    return daily(spark, d)


@query("panel_items", "SELECT ((year(l_shipdate) - 1980) * 12 + month(l_shipdate))::INTEGER AS month_id, l_suppkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS y FROM lineitem GROUP BY 1, 2")
def panel_items(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy(calendar.month_id(F.col("l_shipdate")).alias("month_id"), "l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("y"))


@query("panel_slice", f"WITH {PM} SELECT month_id, nation, y FROM pm WHERE month_id BETWEEN {T0} AND {T1}")
def panel_slice(spark, d):
    return panel.between(monthly(spark, d), MONTHLY, T0, T1).select("month_id", "nation", "y")


@query("panel_subset", f"WITH {PM} SELECT month_id, nation, y FROM pm WHERE month_id % 12 = 0 AND month_id BETWEEN {T0} AND {S1}")
def panel_subset(spark, d):
    ends = [m for m in range(T0, S1 + 1) if m % 12 == 0]
    return panel.subset(monthly(spark, d), MONTHLY, time_ids=ends).select("month_id", "nation", "y")


@query("panel_airlock", f"WITH {PM} SELECT month_id, nation, y::FLOAT AS y, n::FLOAT AS n FROM pm")
def panel_airlock(spark, d):
    return panel.airlock(monthly(spark, d), MONTHLY)


@query("panel_month_ends", f"WITH {PM} SELECT month_id, nation, last_day(DATE '1980-01-01' + to_months(month_id - 1))::VARCHAR AS month_end FROM pm")
def panel_month_ends(spark, d):
    return monthly(spark, d).select("month_id", "nation", calendar.month_end(F.col("month_id")).cast("string").alias("month_end"))


@query("min_length_filter", f"""WITH {PM_SPARSE}, k AS (SELECT nation FROM pms WHERE month_id BETWEEN {T0} AND {T1} GROUP BY nation HAVING count(*) >= {INPUTS + STEPS})
  SELECT month_id, nation, y FROM pms SEMI JOIN k USING (nation)""")
def min_length_filter(spark, d):
    return panel.long_enough(monthly_sparse(spark, d), MONTHLY, PARTITION, INPUTS + STEPS).select("month_id", "nation", "y")


@query("boundary_audit", f"""WITH {PD_SPARSE} SELECT user_id, max(day_id) AS last,
  CASE WHEN max(day_id) > {DAYS.train[1]} THEN 'leakage' WHEN max(day_id) < {DAYS.train[1]} THEN 'starvation' ELSE 'ok' END AS verdict FROM pds GROUP BY user_id""")
def boundary_audit(spark, d):
    return audit.boundary_audit(daily_sparse(spark, d), DAILY, DAYS.train[1])


@query("contiguity_audit", f"""WITH {PM_SPARSE} SELECT nation, min(month_id) AS first, max(month_id) AS last, count(DISTINCT month_id) AS steps,
  max(month_id) - min(month_id) + 1 = count(DISTINCT month_id) AS contiguous FROM pms GROUP BY nation""")
def contiguity_audit(spark, d):
    return audit.contiguity_audit(monthly_sparse(spark, d), MONTHLY)


@query("hole_list", f"""WITH {PD_SPARSE}, s AS (SELECT user_id, min(day_id) a, max(day_id) b FROM pds GROUP BY 1),
  e AS (SELECT user_id, unnest(range(a, b + 1))::INTEGER AS day_id FROM s) SELECT user_id, day_id FROM e ANTI JOIN pds USING (user_id, day_id)""")
def hole_list(spark, d):
    return audit.holes(daily_sparse(spark, d), DAILY).select("user_id", "day_id")


@query("leak_overlap", f"WITH {PM} SELECT DISTINCT month_id FROM pm WHERE month_id BETWEEN {S0 - INPUTS} AND {T1}")
def leak_overlap(spark, d):
    pm = monthly(spark, d)
    return audit.shared_times(panel.between(pm, MONTHLY, T0, T1), panel.between(pm, MONTHLY, S0 - INPUTS, S1), MONTHLY)


@query("numeric_audit", f"""WITH {PD}, v AS (SELECT 'y' AS "column", y AS x FROM pd UNION ALL SELECT 'n', n FROM pd)
  SELECT "column", count(*) AS rows, count(*) FILTER (x IS NULL OR isnan(x) OR isinf(x)) AS poisoned, count(*) FILTER (abs(x) > 300) AS outliers FROM v GROUP BY 1""")
def numeric_audit(spark, d):
    return audit.numeric_audit(daily(spark, d), ["y", "n"], 300)


def _cycle(column: str, steps: int, name: str) -> str:
    angle = f"2 * pi() * ((({column} - 1) % {steps}) / {steps}.0::DOUBLE)"
    return f"round(sin({angle}), 6) + 0.0::DOUBLE AS {name}_sin, round(cos({angle}), 6) + 0.0::DOUBLE AS {name}_cos"


@query("cyclic_month", f"WITH {PM} SELECT month_id, nation, {_cycle('month_id', 12, 'month')} FROM pm")
def cyclic_month(spark, d):
    return rounded(monthly(spark, d).select("month_id", "nation", *(c.alias(n) for n, c in calendar.cyclic(F.col("month_id"), "month").items())))


@query("cyclic_day", f"WITH {PD} SELECT day_id, user_id, {_cycle('day_id', 7, 'day_of_week')}, {_cycle('day_id', 365, 'day_of_year')} FROM pd")
def cyclic_day(spark, d):
    return rounded(daily(spark, d).select("day_id", "user_id", *(c.alias(n) for n, c in calendar.cyclic(F.col("day_id"), "day").items())))


@query("cyclic_week", f"""WITH w AS (SELECT DISTINCT (datediff('day', DATE '1980-01-01', ts::DATE) // 7 + 1)::INTEGER AS week_id FROM events)
  SELECT week_id, {_cycle('week_id', 52, 'week_of_year')} FROM w""")
def cyclic_week(spark, d):
    weeks = table(spark, d, "events").select(calendar.week_id(F.col("ts")).alias("week_id")).distinct()
    return rounded(weeks.select("week_id", *(c.alias(n) for n, c in calendar.cyclic(F.col("week_id"), "week").items())))


@query("relative_position", f"WITH {PM} SELECT month_id, nation, round((month_id - {T0}) / ({S1} - {T0})::DOUBLE, 6) AS position FROM pm")
def relative_position(spark, d):
    return rounded(monthly(spark, d).select("month_id", "nation", calendar.relative_position(F.col("month_id"), T0, S1).alias("position")))


FP = f"""{PD}, fr AS (SELECT user_id, y, (row_number() OVER (PARTITION BY user_id ORDER BY day_id) - 1)::DOUBLE AS t FROM pd WHERE day_id BETWEEN {DAYS.train[0]} AND {DAYS.train[1]}
), fp AS (SELECT user_id, avg(y) AS mu, coalesce(stddev_samp(y), 0) AS sigma, max(y) AS top, coalesce(regr_slope(y, t), 0) AS trend, avg((y = 0)::INTEGER::DOUBLE) AS sparsity FROM fr GROUP BY user_id)"""


def _fp(transform: str | None):
    return lambda spark, d: rounded(fingerprint.fingerprints(daily(spark, d), DAILY, DAYS.train, transform), 4)


_STATS = ("mu", "sigma", "top", "trend")
_OUT = {"mu": "y_mu", "sigma": "y_sigma", "top": "y_max", "trend": "y_trend"}
query("fingerprint_raw", f"WITH {FP} SELECT user_id, {', '.join(f'round({c}::FLOAT::DOUBLE, 4) AS {_OUT[c]}' for c in _STATS)}, round(sparsity::FLOAT::DOUBLE, 4) AS y_sparsity FROM fp")(_fp(None))
query(
    "fingerprint_asinh_maxabs",
    f"WITH {FP}, a AS (SELECT user_id, sparsity, {', '.join(f'{ASINH.format(c)} AS {c}' for c in _STATS)} FROM fp) SELECT user_id, "
    + ", ".join(f"round((CASE WHEN max(abs({c})) OVER () > 0 THEN {c} / max(abs({c})) OVER () ELSE {c} END)::FLOAT::DOUBLE, 4) AS {_OUT[c]}" for c in _STATS)
    + ", round(sparsity::FLOAT::DOUBLE, 4) AS y_sparsity FROM a",
)(_fp("AsinhTransform->MaxAbsScaler"))
query(
    "fingerprint_log_standard",
    f"WITH {FP}, a AS (SELECT user_id, sparsity, mu, sigma, top, trend FROM fp) SELECT user_id, "
    + ", ".join(f"round((CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE {c} END)::FLOAT::DOUBLE, 4) AS {_OUT[c]}" for c in _STATS)
    + ", round(sparsity::FLOAT::DOUBLE, 4) AS y_sparsity FROM a",
)(_fp("StandardScaler"))


@query("panel_with_fingerprint", f"WITH {FP} SELECT day_id, user_id, y, round(mu::FLOAT::DOUBLE, 4) AS y_mu, round(sparsity::FLOAT::DOUBLE, 4) AS y_sparsity FROM pd LEFT JOIN fp USING (user_id)")
def panel_with_fingerprint(spark, d):
    pd_ = daily(spark, d)
    stats = fingerprint.fingerprints(pd_, DAILY, DAYS.train).select("user_id", "y_mu", "y_sparsity")
    return rounded(fingerprint.with_fingerprints(pd_, stats, DAILY).select("day_id", "user_id", "y", "y_mu", "y_sparsity"), 4)


@query("stat_time_steps", f"WITH {PD} SELECT count(DISTINCT day_id) AS steps FROM pd WHERE day_id BETWEEN {DAYS.train[0]} AND {DAYS.train[1]}")
def stat_time_steps(spark, d):
    return panel.between(daily(spark, d), DAILY, *DAYS.train).agg(F.count_distinct("day_id").alias("steps"))


@query("positions", f"WITH {PM_SPARSE} SELECT nation, month_id, (row_number() OVER (PARTITION BY nation ORDER BY month_id) - 1)::INTEGER AS position FROM pms")
def positions(spark, d):
    return panel.positions(monthly_sparse(spark, d), MONTHLY).select("nation", "month_id", "position")


@query("first_differences", f"WITH {PM}, x AS (SELECT month_id, nation, lead(y) OVER (PARTITION BY nation ORDER BY month_id) - y AS df FROM pm) SELECT month_id, nation, round(df, 4) AS difference FROM x WHERE df IS NOT NULL")
def first_differences(spark, d):
    return rounded(panel.differences(monthly(spark, d), MONTHLY, "y").select("month_id", "nation", "difference"), 4)


@query("split_80_20", f"""WITH {PM} SELECT month_id, nation, y,
  row_number() OVER (PARTITION BY nation ORDER BY month_id) <= floor(count(*) OVER (PARTITION BY nation) * (1 - 0.2::DOUBLE)) AS is_train FROM pm""")
def split_80_20(spark, d):
    return panel.split_by_position(monthly(spark, d), MONTHLY).select("month_id", "nation", "y", "is_train")


@query("event_series", f"WITH {PD} SELECT user_id, bool_or(abs(y) > 100) AS is_event FROM pd GROUP BY user_id")
def event_series(spark, d):
    return panel.signal_entities(daily(spark, d), DAILY, ["y"], 100)


@query("event_cells", f"""WITH {PD}, l AS (SELECT day_id, user_id, y, lag(y) OVER (PARTITION BY user_id ORDER BY day_id) AS p FROM pd)
  SELECT day_id, user_id, greatest(abs(y), abs(p)) > {THRESHOLD} AS is_event, abs(y) <= {THRESHOLD} AND abs(p) > {THRESHOLD} AS false_positive,
         abs(y) > {THRESHOLD} AND abs(p) <= {THRESHOLD} AS false_negative FROM l WHERE p IS NOT NULL""")
def event_cells(spark, d):
    rows = fc.lagged(daily(spark, d), DAILY, "y", 1, "p")
    y, p = F.abs("y") > THRESHOLD, F.abs("p") > THRESHOLD
    return rows.select("day_id", "user_id", (F.greatest(F.abs("y"), F.abs("p")) > THRESHOLD).alias("is_event"), (~y & p).alias("false_positive"), (y & ~p).alias("false_negative"))


@query("series_arrays", f"WITH {PM} SELECT nation, min(month_id) AS start, list(y ORDER BY month_id)::VARCHAR AS y FROM pm GROUP BY nation")
def series_arrays(spark, d):
    rows = panel.as_arrays(monthly(spark, d), MONTHLY, ["y"])
    return rows.select("nation", "start", F.concat(F.lit("["), F.array_join(F.transform("y", lambda v: F.coalesce(number_text(v), F.lit("NULL"))), ", "), F.lit("]")).alias("y"))


_ORIGINS = f"{PM}, o AS (SELECT unnest(range({SEQUENCES})) AS q)"


@query("rolling_origin_windows", f"""WITH {_ORIGINS} SELECT nation, q::INTEGER AS sequence_number, ({S0} + q)::INTEGER AS origin, count(*)::BIGINT AS inputs, round(sum(y), 4) AS total,
  min(month_id) AS first, max(month_id) AS last FROM pm JOIN o ON month_id BETWEEN {S0} + q - {INPUTS} AND {S0} - 1 + q GROUP BY nation, q""")
def rolling_origin_windows(spark, d):
    rows = windows.origins_of_rows(monthly(spark, d), MONTHLY, S0, INPUTS, SEQUENCES)
    found = rows.groupBy("nation", "sequence_number").agg(F.count("*").alias("inputs"), F.sum("y").alias("total"), F.min("month_id").alias("first"), F.max("month_id").alias("last"))
    return rounded(found.withColumn("origin", F.lit(S0) + F.col("sequence_number")), 4)


@query("origin_window_steps", f"WITH {_ORIGINS} SELECT nation, q::INTEGER AS sequence_number, (month_id - {S0} - q + {INPUTS})::INTEGER AS step, y FROM pm JOIN o ON month_id BETWEEN {S0} + q - {INPUTS} AND {S0} - 1 + q")
def origin_window_steps(spark, d):
    found = windows.origin_windows(monthly(spark, d), MONTHLY, "y", S0, INPUTS, SEQUENCES)
    return found.select("nation", "sequence_number", F.posexplode("inputs").alias("step", "y"))


@query("train_windows", f"""WITH {PM}, w AS (SELECT nation, month_id AS start, list(y) OVER f AS w FROM pm WHERE month_id BETWEEN {T0} AND {T1}
  WINDOW f AS (PARTITION BY nation ORDER BY month_id ROWS BETWEEN CURRENT ROW AND {INPUTS + STEPS - 1} FOLLOWING))
  SELECT nation, start, round(list_sum(w[1:{INPUTS}]), 4) AS inputs, round(list_sum(w[{INPUTS + 1}:]), 4) AS outputs FROM w WHERE len(w) = {INPUTS + STEPS}""")
def train_windows(spark, d):
    found = windows.training_windows(monthly(spark, d), MONTHLY, "y", INPUTS, STEPS, time_range=PARTITION.train)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select("nation", "start", total("inputs").alias("inputs"), total("outputs").alias("outputs")), 4)


@query("carved_validation", f"""WITH {PM} SELECT month_id, nation, month_id BETWEEN {T0} AND {T1 - 24} AS in_train, month_id BETWEEN {T1 - 24 - 36 + 1} AND {T1} AS in_validation
  FROM pm WHERE month_id BETWEEN {T0} AND {T1}""")
def carved_validation(spark, d):
    from stratapanel.spec import Partition

    short = Partition(PARTITION.train, (S0, S0 + 11))
    return windows.partition_rows(monthly(spark, d), MONTHLY, short, 36, 24).select("month_id", "nation", "in_train", "in_validation")


@query("forecast_horizon_grid", f"""SELECT n_nationkey AS nation, s::INTEGER AS sequence_number, k::INTEGER AS step, ({S0} + s + k - 1)::INTEGER AS month_id
  FROM nation, range({SEQUENCES}) a(s), range(1, {STEPS + 1}) b(k)""")
def forecast_horizon_grid(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    return windows.forecast_grid(nations, MONTHLY, S0, STEPS, SEQUENCES)


@query("union_timelines", f"""WITH {PM}, {PD} SELECT 'monthly' AS panel, month_id AS t, nation::BIGINT AS entity, y FROM pm UNION ALL SELECT 'daily', day_id, user_id, y FROM pd""")
def union_timelines(spark, d):
    a = monthly(spark, d).select(F.lit("monthly").alias("panel"), F.col("month_id").alias("t"), F.col("nation").cast("long").alias("entity"), "y")
    return a.unionByName(daily(spark, d).select(F.lit("daily").alias("panel"), F.col("day_id").alias("t"), F.col("user_id").alias("entity"), "y"))
