"""Forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import diagnostics, metrics, panel, revin
from stratapanel.operators import forecast as fc
from stratapanel.plans.panels import ASINH, DAILY, DAYS, INPUTS, MONTHLY, PAIRS, PARTITION, PD, PM, STEPS, THRESHOLD, daily, monthly, pairs
from stratapanel.plans.registry import query, rounded

T0, T1 = PARTITION.train
S0, S1 = PARTITION.test
SEQUENCES = PARTITION.origins(STEPS)
BASE = f"bl AS (SELECT nation, greatest(exp(avg(ln(1 + y))) - 1, 0) AS prediction FROM pm WHERE month_id BETWEEN {T0} AND {T1} GROUP BY nation)"
GRID = f"gr AS (SELECT nation, s::INTEGER AS sequence_number, k::INTEGER AS step, ({S0} + s + k - 1)::INTEGER AS month_id FROM (SELECT DISTINCT nation FROM pm), range({SEQUENCES}) a(s), range(1, {STEPS + 1}) b(k))"
CELLS = f"{PM}, {BASE}, {GRID}, ce AS (SELECT gr.*, bl.prediction AS p, pm.y FROM gr JOIN bl USING (nation) JOIN pm USING (nation, month_id))"
#: Naive forecasts of the daily panel by the value a week before.
NAIVE = f"{PD}, ce AS (SELECT * FROM (SELECT day_id, user_id, y, lag(y, 7) OVER (PARTITION BY user_id ORDER BY day_id) AS p FROM pd) WHERE p IS NOT NULL)"


def _point(p: str = "p", y: str = "y", digits: int = 4) -> str:
    err = f"(ln(1 + greatest({p}, 0)) - ln(1 + greatest({y}, 0)))"
    return f"count(*) AS n, round(avg(({p} - {y}) * ({p} - {y})) / 1e6, {digits}) AS mse, round(avg({err} * {err}), 6) AS msle, round(sqrt(avg({err} * {err})), 6) AS rmsle, round(avg(abs({p} - {y})), {digits}) AS mae, round(CASE WHEN stddev_pop({p}) * stddev_pop({y}) > 1e-9 THEN corr({p}, {y}) END, 6) AS pearson, round(coalesce(avg({p} / y) FILTER ({y} > 0), 1), 6) AS ratio"


def _shown(df):
    """Squared errors in millions, so that rounding means the same to both engines."""
    out = df.withColumn("mse", F.col("mse") / 1e6)
    return out.select(*(F.round(c, 4).alias(c) if c in ("mse", "mae") else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def cells(spark, d):
    pm = monthly(spark, d)
    return metrics.scored(fc.baseline_forecast(pm, MONTHLY, "y", PARTITION, STEPS, SEQUENCES), pm, ["nation", "month_id"], "prediction", "y")


def naive(spark, d):
    return fc.lagged(daily(spark, d), DAILY, "y", 7, "p")


@query(
    "experiment_baseline",
    f"""WITH {PM}, sp AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY month_id) <= floor(count(*) OVER (PARTITION BY nation) * (1 - 0.2::DOUBLE)) AS is_train FROM pm
), b AS (SELECT nation, greatest(exp(avg(ln(1 + y))) - 1, 0) AS p FROM sp WHERE is_train GROUP BY nation), ce AS (SELECT p, y FROM sp JOIN b USING (nation) WHERE NOT is_train)
SELECT {_point()} FROM ce""",
)
def experiment_baseline(spark, d):
    """Split each nation 80/20 in time, predict the mean log of its training months, score the rest."""
    parts = panel.split_by_position(monthly(spark, d), MONTHLY)
    fitted = fc.log_mean_baseline(parts.where("is_train"), MONTHLY, "y")
    held_out = parts.where("not is_train").join(fitted, "nation").withColumnRenamed("prediction", "p")
    return _shown(metrics.metrics(held_out))


@query("baseline_forecast", f"WITH {PM}, {BASE}, {GRID} SELECT nation, sequence_number, step, month_id, round(prediction, 4) AS prediction FROM gr JOIN bl USING (nation)")
def baseline_forecast(spark, d):
    return rounded(fc.baseline_forecast(monthly(spark, d), MONTHLY, "y", PARTITION, STEPS, SEQUENCES), 4)


@query("naive_seasonal_forecast", f"WITH {PM}, {GRID} SELECT gr.nation, sequence_number, step, gr.month_id, y AS prediction FROM gr JOIN pm ON pm.nation = gr.nation AND pm.month_id = gr.month_id - 12 * ceil(step / 12.0)::INTEGER")
def naive_seasonal_forecast(spark, d):
    return fc.seasonal_naive(monthly(spark, d), MONTHLY, "y", PARTITION, 12, STEPS, SEQUENCES).select("nation", "sequence_number", "step", "month_id", "prediction")


@query("last_value_forecast", f"WITH {PM}, l AS (SELECT nation, max_by(y, month_id) AS prediction FROM pm WHERE month_id BETWEEN {T0} AND {T1} GROUP BY nation) SELECT nation, 0::INTEGER AS sequence_number, k::INTEGER AS step, ({S0} + k - 1)::INTEGER AS month_id, prediction FROM l, range(1, {STEPS + 1}) b(k)")
def last_value_forecast(spark, d):
    return fc.last_value(monthly(spark, d), MONTHLY, "y", PARTITION, STEPS)


@query("prediction_frame", f"WITH {PM}, {BASE}, {GRID} SELECT DISTINCT month_id, nation, round(prediction::FLOAT::DOUBLE, 1) AS pred_y, 1::INTEGER AS samples FROM gr JOIN bl USING (nation) WHERE sequence_number = 0")
def prediction_frame(spark, d):
    points = fc.baseline_forecast(monthly(spark, d), MONTHLY, "y", PARTITION, STEPS)
    frame = fc.prediction_frame(points, MONTHLY, {"y": F.col("prediction")})
    return frame.select("month_id", "nation", F.round(F.col("pred_y")[0].cast("double"), 1).alias("pred_y"), F.size("pred_y").alias("samples"))


@query("metrics_overall", f"WITH {CELLS} SELECT {_point()} FROM ce")
def metrics_overall(spark, d):
    return _shown(metrics.metrics(cells(spark, d)))


for _name, _column in (("step", "step"), ("month", "month_id"), ("sequence", "sequence_number"), ("entity", "nation")):

    @query(f"metrics_by_{_name}", f"WITH {CELLS} SELECT {_column}, {_point()} FROM ce GROUP BY {_column}")
    def _by(spark, d, column=_column):
        return _shown(metrics.metrics(cells(spark, d), [column]))


@query(
    "metrics_by_each",
    f"WITH {CELLS}, u AS (SELECT 'step' AS dimension, step::BIGINT AS value, p, y FROM ce UNION ALL SELECT 'month_id', month_id, p, y FROM ce UNION ALL SELECT 'sequence_number', sequence_number, p, y FROM ce) SELECT dimension, value, {_point()} FROM u GROUP BY 1, 2",
)
def metrics_by_each(spark, d):
    return _shown(metrics.metrics_by_each(cells(spark, d), ["step", "month_id", "sequence_number"]))


@query("pred_true_ratio", f"WITH {NAIVE} SELECT round(coalesce(avg(greatest(p, 0) / y) FILTER (y > 0), 1), 6) AS ratio FROM ce")
def pred_true_ratio(spark, d):
    return rounded(metrics.mean_ratio(naive(spark, d)))


@query("metrics_daily", f"WITH {NAIVE} SELECT {_point()} FROM ce")
def metrics_daily(spark, d):
    return _shown(metrics.metrics(naive(spark, d)))


_EVENT = "max(abs(y)) OVER (PARTITION BY user_id) > 100"


@query(
    "yhat_bar",
    f"""WITH {NAIVE}, c AS (SELECT *, {_EVENT} AS is_event FROM ce) SELECT count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(y), 4) AS mean_y, round(quantile_disc(p, 0.5), 4) AS median_p,
  round(CASE WHEN avg(y) > 1e-6 THEN avg(p) / avg(y) END, 4) AS ratio, round(avg(p - y), 4) AS bias, round(stddev_samp(p), 4) AS std_p, round(stddev_samp(y), 4) AS std_y,
  round(avg(p) FILTER (is_event), 4) AS event_mean_p, round(avg(y) FILTER (is_event), 4) AS event_mean_y, round(avg(p) FILTER (NOT is_event), 4) AS peace_mean_p, count(*) FILTER (is_event) AS event_cells FROM c""",
)
def yhat_bar(spark, d):
    return rounded(metrics.calibration(naive(spark, d), 100, ["user_id"]), 4)


@query("event_peace_split", f"WITH {NAIVE}, c AS (SELECT *, {_EVENT} AS is_event FROM ce) SELECT is_event, {_point()} FROM c GROUP BY is_event")
def event_peace_split(spark, d):
    rows = naive(spark, d).withColumn("is_event", F.max(F.abs("y")).over(Window.partitionBy("user_id")) > 100)
    return _shown(metrics.metrics(rows, ["is_event"]))


@query(
    "average_precision",
    f"WITH {NAIVE}, g AS (SELECT p, count(*) AS n, count(*) FILTER (y > 0) AS h FROM ce GROUP BY p), c AS (SELECT h, sum(h) OVER (ORDER BY p DESC) AS found, sum(n) OVER (ORDER BY p DESC) AS seen FROM g) SELECT round(sum(h * found::DOUBLE / seen) / sum(h), 6) AS average_precision FROM c",
)
def average_precision(spark, d):
    return rounded(metrics.average_precision(naive(spark, d)))


_BINS = [0.0, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0]


@query("earth_mover", f"WITH {NAIVE} SELECT round({' + '.join(f'abs(avg((p <= {a})::INTEGER::DOUBLE) - avg((y <= {a})::INTEGER::DOUBLE)) * {b - a}' for a, b in zip(_BINS, _BINS[1:]))}, 6) AS earth_mover FROM ce")
def earth_mover(spark, d):
    return rounded(metrics.earth_mover(naive(spark, d), _BINS))


#: Samples of a day: the values of the seven days before.
SAMPLES = f"{PD}, w AS (SELECT day_id, user_id, y, list(y) OVER (PARTITION BY user_id ORDER BY day_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS x FROM pd), ce AS (SELECT *, list_sort(x) AS s FROM w WHERE len(x) = 7)"


def sampled(spark, d):
    before = Window.partitionBy("user_id").orderBy("day_id").rowsBetween(-7, -1)
    return daily(spark, d).withColumn("x", F.collect_list("y").over(before)).where(F.size("x") == 7)


def _quantile(q: float) -> str:
    at = q * 6
    return f"(s[{int(at) + 1}] + (s[{min(int(at) + 2, 7)}] - s[{int(at) + 1}]) * {at - int(at)!r}::DOUBLE)"


@query("crps_samples", f"WITH {SAMPLES}, t AS (SELECT list_sum(list_transform(x, lambda a: abs(a - y))) / 7 - list_sum(list_transform(x, lambda a: list_sum(list_transform(x, lambda b: abs(a - b))))) / 98 AS c FROM ce) SELECT round(avg(c), 4) AS crps FROM t")
def crps_samples(spark, d):
    return rounded(metrics.sample_metrics(sampled(spark, d), "x").select("crps"), 4)


@query(
    "coverage_samples",
    f"WITH {SAMPLES}, q AS (SELECT y, {_quantile(0.05)} AS lo, {_quantile(0.95)} AS hi FROM ce) SELECT round(avg((y BETWEEN lo AND hi)::INTEGER::DOUBLE), 4) AS coverage, round(avg(hi - lo + 20 * (greatest(lo - y, 0) + greatest(y - hi, 0))), 4) AS mis FROM q",
)
def coverage_samples(spark, d):
    return rounded(metrics.sample_metrics(sampled(spark, d), "x").select("coverage", "mis"), 4)


@query(
    "ignorance_samples",
    f"WITH {SAMPLES}, m AS (SELECT y, list_avg(x) AS mu, greatest(list_stddev_pop(x), 1e-6) AS sd FROM ce), s AS (SELECT count(*) AS n, avg((ln(sd) + 0.5 * ((y - mu) / sd) * ((y - mu) / sd) + 0.9189385332046727::DOUBLE) / 0.6931471805599453::DOUBLE) AS ignorance FROM m) SELECT n, round(sign(ignorance) * ln(1 + abs(ignorance)), 4) AS log_ignorance FROM s",
)
def ignorance_samples(spark, d):
    rows = sampled(spark, d)  # cells whose samples are all equal are scored with the least spread
    found = metrics.sample_metrics(rows.withColumn("one", F.lit(1)), "x", by=["one"])
    return rounded(found.crossJoin(rows.agg(F.count("*").alias("n"))).select("n", (F.signum("ignorance") * F.log1p(F.abs("ignorance"))).alias("log_ignorance")), 4)


@query("prediction_sanity", f"WITH {NAIVE}, m AS (SELECT avg(p) AS mean, stddev_samp(p) AS std, min(p) AS low, max(p) AS high FROM ce) SELECT round(mean, 4) AS mean, round(std, 4) AS std, low, high, round(avg((abs(p - mean) < 1e-3)::INTEGER::DOUBLE), 4) AS near_mean, false AS collapsed FROM ce, m GROUP BY mean, std, low, high")
def prediction_sanity(spark, d):
    return rounded(metrics.prediction_sanity(naive(spark, d)), 4)


@query("linear_forecast")
def linear_forecast(spark, d):
    """Ridge regression on the monthly panel, all origins."""
    pm = monthly(spark, d)
    model = fc.LinearForecaster("NLinearModel", INPUTS, STEPS).fit(pm, MONTHLY, "y", PARTITION.train)
    return model.predict(pm, MONTHLY, "y", S0, SEQUENCES)


@query("linear_forecast_samples")
def linear_forecast_samples(spark, d):
    pm = monthly(spark, d)
    model = fc.LinearForecaster("DLinearModel", INPUTS, STEPS).fit(pm, MONTHLY, "y", PARTITION.train)
    return model.predict(pm, MONTHLY, "y", S0, SEQUENCES, num_samples=20, seed=7)


_SINH = "((exp({0}) - exp(-({0}))) / 2)"
_ASINH = "(sign({0}) * ln(abs({0}) + sqrt(({0}) * ({0}) + 1)))"
REVIN = f"""{PD}, rz AS (SELECT user_id, day_id, {ASINH.format("y")} AS x FROM pd), rm AS (SELECT *, avg(x) OVER (PARTITION BY user_id) AS mu FROM rz
), rc AS (SELECT *, {_SINH.format("x - mu")} AS c FROM rm), rs AS (SELECT *, sqrt(var_pop(c) OVER (PARTITION BY user_id) + 1e-5::DOUBLE) AS sigma FROM rc)"""


def normalised(spark, d):
    from stratapanel.functions.elementary import asinh

    return revin.normalise(daily(spark, d).select("user_id", "day_id", asinh(F.col("y")).alias("x")), ["user_id"], "x")


@query("revin_forward", f"WITH {REVIN} SELECT user_id, day_id, round(mu, 5) AS mu, round(sigma, 5) AS sigma, round({_ASINH.format('c / sigma')}, 5) + 0.0::DOUBLE AS z FROM rs")
def revin_forward(spark, d):
    return rounded(normalised(spark, d).select("user_id", "day_id", "mu", "sigma", "z"), 5)


@query(
    "revin_inverse",
    f"WITH {REVIN}, cap AS (SELECT 5 * avg(sigma) AS cap FROM (SELECT DISTINCT user_id, sigma FROM rs)) SELECT user_id, day_id, round({_ASINH.format('c / sigma * least(sigma, cap)')} + mu, 5) + 0.0::DOUBLE AS x FROM rs, cap",
)
def revin_inverse(spark, d):
    return rounded(revin.denormalise(normalised(spark, d).drop("x"), [], ["user_id"]).select("user_id", "day_id", "x"), 5)


@query(
    "revin_moments",
    f"WITH {REVIN}, u AS (SELECT DISTINCT user_id, mu, sigma FROM rs) SELECT round(min(mu), 5) AS mu_min, round(max(mu), 5) AS mu_max, round(avg(mu), 5) AS mu_avg, round(min(sigma), 5) AS sigma_min, round(max(sigma), 5) AS sigma_max, round(avg(sigma), 5) AS sigma_avg, round(max(sigma) / greatest(abs(max(mu)), 1), 5) AS cv_max FROM u",
)
def revin_moments(spark, d):
    return rounded(revin.moments(normalised(spark, d), ["user_id"]), 5)


@query("timeline_stats", f"WITH {PD} SELECT user_id, round(avg(y), 8) AS mean, round(stddev_pop(y), 8) AS std, min(y) AS low, max(y) AS high, count(*) FILTER (y = 0) AS zeros, round(avg((y = 0)::INTEGER::DOUBLE), 8) AS zero_share, round(coalesce(avg(y) FILTER (y <> 0), 0), 8) AS mean_nonzero FROM pd GROUP BY user_id")
def timeline_stats(spark, d):
    return rounded(diagnostics.timeline_stats(daily(spark, d), "user_id", "y"), 8)


_DESCRIBED = ("mean", "std", "zero_share")


@query(
    "describe_stats",
    f"WITH {PD}, t AS (SELECT avg(y) AS mean, stddev_pop(y) AS std, avg((y = 0)::INTEGER::DOUBLE) AS zero_share FROM pd GROUP BY user_id), v AS ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", {c} AS x FROM t''' for c in _DESCRIBED)})"
    + ' SELECT "column", count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS low, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS high FROM v GROUP BY 1',
)
def describe_stats(spark, d):
    return rounded(diagnostics.describe(diagnostics.timeline_stats(daily(spark, d), "user_id", "y"), list(_DESCRIBED)), 4)


@query("pairs_scored", f"WITH {PAIRS} SELECT s, k, round(p, 6) AS p, round(y, 6) AS y, greatest(abs(y), abs(p)) > {THRESHOLD} AS is_event FROM pr")
def pairs_scored(spark, d):
    return rounded(pairs(spark, d).select("s", "k", "p", "y", (F.greatest(F.abs("y"), F.abs("p")) > THRESHOLD).alias("is_event")))


@query("daily_test_scores", f"WITH {NAIVE} SELECT day_id, {_point()} FROM ce WHERE day_id BETWEEN {DAYS.test[0]} AND {DAYS.test[1]} GROUP BY day_id")
def daily_test_scores(spark, d):
    return _shown(metrics.metrics(panel.between(naive(spark, d), DAILY, *DAYS.test), ["day_id"]))
