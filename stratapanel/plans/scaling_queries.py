"""Scalers, chains, routing and inverses."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.functions import normal
from stratapanel.functions.transforms import log_target, unlog_target
from stratapanel.operators import audit, panel
from stratapanel.operators.scaling import GroupedScaler, Scaler
from stratapanel.plans.panels import ASINH, DAILY, DAYS, PD, daily
from stratapanel.plans.registry import query, rounded

TRAIN = f"day_id BETWEEN {DAYS.train[0]} AND {DAYS.train[1]}"
LOG, UNLOG = "ln(1 + {0})", "(exp({0}) - 1)"
SINH = "((exp({0}) - exp(-{0})) / 2)"


def _scaled(spec, columns=("y",), digits: int = 6):
    """Fitted on the training days, applied to all."""

    def run(spark, d):
        rows = daily(spark, d).select("day_id", "user_id", *columns)
        scaler = Scaler(spec, list(columns)).fit(panel.between(rows, DAILY, *DAYS.train))
        return rounded(scaler.transform(rows), digits)

    return run


def _fitted_sql(parameters: str, value: str, x: str = "y") -> str:
    return f"WITH {PD}, b AS (SELECT day_id, user_id, {x} AS x FROM pd), f AS (SELECT {parameters} FROM b WHERE {TRAIN}) SELECT day_id, user_id, round({value}, 6) + 0.0::DOUBLE AS y FROM b, f"


AFFINE = {
    "standard": ("StandardScaler", "avg(x) AS c, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s"),
    "robust": ("RobustScaler", "quantile_cont(x, 0.5) AS c, CASE WHEN quantile_cont(x, 0.75) = quantile_cont(x, 0.25) THEN 1 ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS s"),
    "minmax": ("MinMaxScaler", "min(x) AS c, CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END AS s"),
    "maxabs": ("MaxAbsScaler", "0 AS c, CASE WHEN max(abs(x)) = 0 THEN 1 ELSE max(abs(x)) END AS s"),
}
for _key, (_name, _parameters) in AFFINE.items():
    query(f"scale_{_key}", _fitted_sql(_parameters, "(x - c) / s"))(_scaled(_name))
    query(f"scale_chain_asinh_{_key}", _fitted_sql(_parameters, "(x - c) / s", ASINH.format("y")))(_scaled(f"AsinhTransform->{_name}"))

for _key, _name, _sql in (
    ("asinh", "AsinhTransform", ASINH.format("y")),
    ("log", "LogTransform", LOG.format("y")),
    ("sqrt", "SqrtTransform", "sqrt(greatest(y, 0))"),
    ("fourthroot", "FourthRootTransform", "pow(1 + greatest(y, 0), 0.25::DOUBLE) - 1"),
    ("passthrough", "PassThrough", "y"),
):
    query(f"scale_{_key}", f"WITH {PD} SELECT day_id, user_id, round({_sql}, 6) AS y FROM pd")(_scaled(_name))


@query("scale_minmax_range", _fitted_sql(AFFINE["minmax"][1], "(x - c) / s * 2 - 1"))
def scale_minmax_range(spark, d):
    return _scaled({"name": "MinMaxScaler", "kwargs": {"feature_range": (-1.0, 1.0)}})(spark, d)


@query("scale_robust_wide", _fitted_sql("quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.9) - quantile_cont(x, 0.1) AS s", "(x - c) / s"))
def scale_robust_wide(spark, d):
    return _scaled({"name": "RobustScaler", "kwargs": {"quantile_range": (10.0, 90.0)}})(spark, d)


@query("scale_roundtrip", f"WITH {PD} SELECT day_id, user_id, round(y, 4) AS y, round(n::DOUBLE, 4) AS n FROM pd")
def scale_roundtrip(spark, d):
    rows = daily(spark, d)
    scaler = Scaler("AsinhTransform->RobustScaler->MinMaxScaler", ["y", "n"]).fit(panel.between(rows, DAILY, *DAYS.train))
    return rounded(scaler.inverse_transform(scaler.transform(rows)), 4).select("day_id", "user_id", (F.col("y") + 0.0).alias("y"), (F.col("n") + 0.0).alias("n"))


@query(
    "scale_group_routing",
    f"""WITH {PD}, f AS (SELECT max(abs({ASINH.format('y')})) AS sy, quantile_cont(n::DOUBLE, 0.5) AS cn,
  CASE WHEN quantile_cont(n::DOUBLE, 0.75) = quantile_cont(n::DOUBLE, 0.25) THEN 1 ELSE quantile_cont(n::DOUBLE, 0.75) - quantile_cont(n::DOUBLE, 0.25) END AS sn FROM pd WHERE {TRAIN})
  SELECT day_id, user_id, round({ASINH.format('y')} / sy, 6) AS y, round((n - cn) / sn, 6) + 0.0::DOUBLE AS n, day_id % 7 AS untouched FROM pd, f""",
)
def scale_group_routing(spark, d):
    rows = daily(spark, d).withColumn("untouched", F.col("day_id") % 7)
    scaler = GroupedScaler({"money": {"scaler": "AsinhTransform->MaxAbsScaler", "features": ["y"]}}, all_columns=["y", "n"])
    return rounded(scaler.fit(panel.between(rows, DAILY, *DAYS.train)).transform(rows))


#: Ranks between the first and the last of 1,000 quantiles that equal a value, or between the two beside it.
_RANKED = f"""WITH {PD}, b AS (SELECT day_id, user_id, y AS x FROM pd), t AS (SELECT list(x ORDER BY x) AS v, count(*) AS n FROM b WHERE {TRAIN}),
  p AS (SELECT i, i::DOUBLE / 999 * (n - 1) AS place, v FROM t, range(1000) s(i)),
  g AS (SELECT i, v[floor(place)::BIGINT + 1] + (v[ceil(place)::BIGINT + 1] - v[floor(place)::BIGINT + 1]) * (place - floor(place)) AS q FROM p),
  k AS (SELECT q, min(i) AS low, max(i) AS high, lead(q) OVER (ORDER BY q) AS after FROM g GROUP BY q),
  r AS (SELECT day_id, user_id, CASE WHEN q IS NULL THEN 0 WHEN x = q THEN (low + high) / 2.0::DOUBLE / 999 WHEN after IS NULL THEN 1 ELSE (high + (x - q) / (after - q)) / 999 END AS p FROM b ASOF LEFT JOIN k ON b.x >= k.q)"""
_UNIFORM = f"{_RANKED} SELECT day_id, user_id, round(p, 6)::DOUBLE AS y FROM r"


def _polynomial_sql(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _ratio_sql(x: str, over, under) -> str:
    return f"{_polynomial_sql(x, over)} / {_polynomial_sql(x, under)}"


#: Normal scores of ranks, no share below a ten-millionth.
_SCORES = f"""{_RANKED}, c AS (SELECT day_id, user_id, greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS p FROM r),
  d AS (SELECT *, p - 0.5::DOUBLE AS q, 0.180625::DOUBLE - (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS near, sqrt(-ln(least(p, 1 - p))) AS far FROM c),
  e AS (SELECT *, far - 1.6::DOUBLE AS middle, far - 5 AS tail FROM d)
  SELECT day_id, user_id, round(CASE WHEN abs(q) <= 0.425::DOUBLE THEN q * {_ratio_sql('near', normal.CENTRE, normal.CENTRE_UNDER)}
    ELSE sign(q) * CASE WHEN far <= 5 THEN {_ratio_sql('middle', normal.MIDDLE, normal.MIDDLE_UNDER)} ELSE {_ratio_sql('tail', normal.TAIL, normal.TAIL_UNDER)} END END, 6) + 0.0::DOUBLE AS y FROM e"""


@query("scale_quantile_uniform", _UNIFORM)
def scale_quantile_uniform(spark, d):
    return _scaled("QuantileUniform")(spark, d)


@query("scale_quantile_normal", _SCORES)
def scale_quantile_normal(spark, d):
    return _scaled("QuantileNormal")(spark, d)


def _power_sql(lam: str) -> str:
    up = f"CASE WHEN {lam} = 0 THEN ln(1 + x) ELSE (pow(x + 1, {lam}) - 1) / nullif({lam}, 0) END"
    down = f"CASE WHEN {lam} = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - {lam}) - 1) / nullif(2 - {lam}, 0) END"
    return f"CASE WHEN x >= 0 THEN {up} ELSE {down} END"


def _likelihood_search_sql(rounds: int = 4) -> str:
    """The power by rounds of 17 candidates, each round between the neighbours of the best one before."""
    ctes = ["r0 AS (SELECT -3.0::DOUBLE AS low, 5.0::DOUBLE AS high)"]
    for i in range(1, rounds + 1):
        ctes.append(f"s{i} AS (SELECT i, lam, (lam - 1) * sum(sign(x) * ln(1 + abs(x))) - count(x) / 2.0::DOUBLE * ln(greatest(var_pop({_power_sql('lam')}), 1e-300::DOUBLE)) AS score FROM (SELECT i, low + i * ((high - low) / 16) AS lam FROM r{i - 1}, range(17) t(i)), b WHERE {TRAIN} GROUP BY i, lam)")
        ctes.append(f"r{i} AS (SELECT min(lam) AS low, max(lam) AS high FROM s{i} WHERE abs(i - (SELECT arg_max(i, score) FROM s{i})) <= 1)")
    return ", ".join(ctes) + f", pw AS (SELECT (low + high) / 2 AS lam FROM r{rounds})"


_YEO_JOHNSON = f"""WITH {PD}, b AS (SELECT day_id, user_id, y AS x FROM pd), {_likelihood_search_sql()},
  z AS (SELECT day_id, user_id, {_power_sql('lam')} AS z FROM b, pw), f AS (SELECT avg(z) AS c, CASE WHEN stddev_pop(z) = 0 THEN 1 ELSE stddev_pop(z) END AS s FROM z WHERE {TRAIN})
  SELECT day_id, user_id, round((z - c) / s, 6) + 0.0::DOUBLE AS y FROM z, f"""


@query("scale_yeo_johnson", _YEO_JOHNSON)
def scale_yeo_johnson(spark, d):
    return _scaled("YeoJohnson")(spark, d)


@query("log_targets", f"WITH {PD} SELECT day_id, user_id, round(({LOG.format('greatest(y, 0)')})::FLOAT::DOUBLE, 4) AS z FROM pd")
def log_targets(spark, d):
    return rounded(daily(spark, d).select("day_id", "user_id", log_target(F.col("y")).alias("z")), 4)


@query("log_targets_inverse", f"WITH {PD} SELECT day_id, user_id, round({UNLOG.format('ln(1 + greatest(y, 0))')}, 4) AS y FROM pd")
def log_targets_inverse(spark, d):
    return rounded(daily(spark, d).select("day_id", "user_id", unlog_target(F.log1p(F.greatest("y", F.lit(0.0)))).alias("y")), 4)


@query("log_features", f"WITH {PD} SELECT day_id, user_id, y, round({LOG.format('n')}, 6) AS n FROM pd")
def log_features(spark, d):
    return rounded(panel.log_features(daily(spark, d).withColumn("n", F.col("n").cast("double")), ["n"]))


@query("sample_inverse", f"WITH {PD}, s AS (SELECT user_id, list(y ORDER BY day_id) AS v, max(abs({ASINH.format('y')})) AS m FROM pd GROUP BY user_id), a AS (SELECT max(m) AS m FROM s) SELECT user_id, round(list_sum(list_transform(v, lambda x: {SINH.format('(x / 400.0::DOUBLE * a.m)')})), 3) AS total FROM s, a")
def sample_inverse(spark, d):
    rows = daily(spark, d)
    scaler = Scaler("AsinhTransform->MaxAbsScaler", ["y"]).fit(rows)
    samples = panel.as_arrays(rows, DAILY, ["y"]).select("user_id", F.transform("y", lambda v: v / 400).alias("samples"))
    back = scaler.inverse_samples(samples, "y", "samples")
    return rounded(back.select("user_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), 3)


@query(
    "quantile_sample_inverse",
    f"""{_RANKED}, l AS (SELECT list(q ORDER BY i) AS v FROM g), z AS (SELECT day_id, user_id, unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) * p AS s FROM r),
  a AS (SELECT day_id, user_id, v, least(floor(s * 999), 998)::BIGINT AS k, s * 999 AS place FROM z, l)
  SELECT day_id, user_id, round(sum(v[k + 1] + (v[k + 2] - v[k + 1]) * (place - k)), 3) AS total FROM a GROUP BY 1, 2""",
)
def quantile_sample_inverse(spark, d):
    """Four samples of each cell in the space of ranks, brought back by the inverse of the quantile scaler."""
    rows = daily(spark, d).select("day_id", "user_id", "y")
    scaler = Scaler("QuantileUniform", ["y"]).fit(panel.between(rows, DAILY, *DAYS.train))
    ranks = scaler.transform(rows).select("day_id", "user_id", F.array(*(k * F.col("y") for k in (0.0, 0.25, 0.5, 1.0))).alias("samples"))
    back = scaler.inverse_samples(ranks, "y", "samples")
    return rounded(back.select("day_id", "user_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), 3)


_SIDES = "UNION ALL".join(f" SELECT '{side}' AS side, '{c}' AS \"column\", {x} AS x FROM w " for side, c, x in (("before", "y", "z"), ("before", "n", "m"), ("after", "y", "y"), ("after", "n", "n")))


@query(
    "inverse_moments",
    f"""WITH {PD}, w AS (SELECT y, n::DOUBLE AS n, {ASINH.format('y')} / max(abs({ASINH.format('y')})) OVER () AS z, {ASINH.format('n')} / max(abs({ASINH.format('n')})) OVER () AS m FROM pd), v AS ({_SIDES})
  SELECT side, "column", count(*) AS n, round(min(x), 4) AS low, round(avg(x), 4) AS mean, round(max(x), 4) AS high, round(stddev_pop(x), 4) AS std, 0::BIGINT AS nan, 0::BIGINT AS inf FROM v GROUP BY 1, 2""",
)
def inverse_moments(spark, d):
    """Moments of both sides of an inverse transform, observed by the job that writes its result."""
    rows = daily(spark, d)
    scaler = Scaler("AsinhTransform->MaxAbsScaler", ["y", "n"]).fit(rows)
    after, seen = audit.watched_inverse(scaler.transform(rows), scaler, ["y", "n"])
    after.write.format("noop").mode("overwrite").save()
    return rounded(audit.moments(spark, seen, ["y", "n"]), 4)
