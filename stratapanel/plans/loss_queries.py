"""Losses as evaluation metrics, on the daily panel in asinh space."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import functions as F

from stratapanel.functions.losses import cell_loss, time_aware_weighted_huber
from stratapanel.operators import robust_losses as R
from stratapanel.plans.panels import LOSS_STEPS, PAIRS, THRESHOLD, pairs
from stratapanel.plans.registry import query, r, rounded

HUBER = "(CASE WHEN abs(e) <= {d} THEN 0.5 * e * e ELSE {d} * (abs(e) - 0.5 * {d}) END)"
SOFTPLUS = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"
SIGMOID = "(1 / (1 + exp(-({0}))))"
LOG_COSH = f"(abs({{0}}) + ln(1 + exp(-2 * abs({{0}}))) - {log(2.0)!r}::DOUBLE)"
TAU = THRESHOLD

#: name -> (manifest name, parameters, SQL of the cell's loss)
CELLS = {
    "loss_weighted_huber": ("WeightedHuberLoss", {"zero_threshold": TAU, "delta": 1.0, "non_zero_weight": 10.0}, f"CASE WHEN abs(y) > {TAU} THEN 10 ELSE 1 END * {HUBER.format(d=1.0)}"),
    "loss_weighted_penalty_huber": (
        "WeightedPenaltyHuberLoss",
        {"zero_threshold": TAU, "delta": 1.0, "non_zero_weight": 5.0, "false_positive_weight": 2.0, "false_negative_weight": 3.0},
        f"CASE WHEN abs(y) > {TAU} THEN 5 ELSE 1 END * CASE WHEN abs(y) <= {TAU} AND abs(p) > {TAU} THEN 2 WHEN abs(y) > {TAU} AND abs(p) <= {TAU} THEN 3 ELSE 1 END * {HUBER.format(d=1.0)}",
    ),
    "loss_spike_focal": ("SpikeFocalLoss", {"alpha": 0.8, "gamma": 2.0, "spike_threshold": 3.0}, "CASE WHEN y > 3 THEN 0.8::DOUBLE * pow(1 - exp(-abs(e)), 2) ELSE (1 - 0.8::DOUBLE) * pow(exp(-abs(e)), 2) END * e * e"),
    "loss_tweedie": (
        "TweedieLoss",
        {"power": 1.5, "non_zero_weight": 5.0, "zero_threshold": TAU, "false_positive_weight": 2.0, "false_negative_weight": 3.0, "eps": 1e-8},
        f"(SELECT CASE WHEN greatest(y, 0) > {TAU} THEN 5 ELSE 1 END * CASE WHEN greatest(y, 0) <= {TAU} AND mu > {TAU} THEN 2 WHEN greatest(y, 0) > {TAU} AND mu <= {TAU} THEN 3 ELSE 1 END * (pow(mu, 0.5::DOUBLE) / 0.5::DOUBLE - greatest(y, 0) * pow(mu, -0.5::DOUBLE) / -0.5::DOUBLE) FROM (SELECT {SOFTPLUS.format('p')} + 1e-8::DOUBLE AS mu))",
    ),
    "loss_asymmetric_quantile": ("AsymmetricQuantileLoss", {"tau": 0.75, "non_zero_weight": 5.0, "zero_threshold": 0.1}, "CASE WHEN abs(y) > 0.1 THEN 5 ELSE 1 END * CASE WHEN y - p >= 0 THEN 0.75 * (y - p) ELSE -0.25 * (y - p) END"),
    "loss_zero_inflated": (
        "ZeroInflatedLoss",
        {"zero_weight": 1.0, "count_weight": 2.0, "delta": 0.5, "zero_threshold": 0.01, "eps": 1e-8},
        f"(SELECT CASE WHEN abs(y) < 0.01 THEN -ln(q) ELSE -ln(1 - q) + 2 * 0.25 * (sqrt(1 + (e / 0.5) * (e / 0.5)) - 1) END FROM (SELECT least(greatest({SIGMOID.format('-10 * p')}, 1e-8::DOUBLE), 1 - 1e-8::DOUBLE) AS q))",
    ),
    "loss_shrinkage": ("ShrinkageLoss", {"a": 10.0, "c": 0.2}, "e * e / (1 + exp(10 * (0.2::DOUBLE - abs(e))))"),
    "loss_charbonnier": ("CharbonnierLoss", {}, "sqrt(e * e + 1e-8::DOUBLE) - 1e-4::DOUBLE"),
    "loss_mse": ("MSELoss", {}, "e * e"),
    "loss_l1": ("L1Loss", {}, "abs(e)"),
    "loss_huber": ("HuberLoss", {"delta": 1.0}, HUBER.format(d=1.0)),
    "loss_smooth_l1": ("SmoothL1Loss", {"beta": 0.5}, f"{HUBER.format(d=0.5)} / 0.5"),
    "loss_poisson_nll": ("PoissonNLLLoss", {}, "exp(p) - y * p"),
}


def _cells(name: str, parameters: dict):
    def run(spark, d):
        return pairs(spark, d).agg(F.count("*").alias("n"), r(F.avg(cell_loss(name, F.col("p"), F.col("y"), **parameters))).alias("loss"))

    return run


for _key, (_name, _parameters, _sql) in CELLS.items():
    query(_key, f"WITH {PAIRS} SELECT count(*) AS n, round(avg({_sql}), 6) AS loss FROM pr")(_cells(_name, _parameters))


@query("loss_by_series", f"WITH {PAIRS} SELECT s, round(avg({CELLS['loss_weighted_huber'][2]}), 6) AS weighted_huber, round(avg(e * e), 6) AS mse FROM pr GROUP BY s")
def loss_by_series(spark, d):
    p, y = F.col("p"), F.col("y")
    found = pairs(spark, d).groupBy("s").agg(F.avg(cell_loss("WeightedHuberLoss", p, y, **CELLS["loss_weighted_huber"][1])).alias("weighted_huber"), F.avg(cell_loss("MSELoss", p, y)).alias("mse"))
    return rounded(found)


@query("loss_time_aware_huber", f"WITH {PAIRS} SELECT round(avg(CASE WHEN abs(y) > 1e-4 THEN 10 ELSE 1 END * pow(0.9::DOUBLE, {LOSS_STEPS} - 1 - k) * {HUBER.format(d=1.0)}), 6) AS loss FROM pr")
def loss_time_aware_huber(spark, d):
    terms = time_aware_weighted_huber(F.col("p"), F.col("y"), F.lit(LOSS_STEPS - 1) - F.col("k"), 1.0, 10.0, 0.9, 1.0)
    return pairs(spark, d).agg(r(F.avg(terms[0])).alias("loss"))


SILU = "({0} / (1 + exp(-({0}))))"
_BASE = "(1.0 / 1.5::DOUBLE * (pow(1 + {0} * {0}, 0.75::DOUBLE) - 1))"


@query(
    "loss_sentinel",
    f"""WITH {PAIRS}, d AS (SELECT *, e - lag(e) OVER w AS de, greatest(abs(y), abs(lag(y) OVER w)) AS top, lag(y) OVER w IS NOT NULL AS has FROM pr WINDOW w AS (PARTITION BY s ORDER BY k)),
  t AS (SELECT avg(pow(1 + abs(y), 0.5::DOUBLE) * {_BASE.format('e')} * (1 + 0.3::DOUBLE * ({SILU.format('e')} + {SILU.format('(-e)')}) * abs(y) / (1 + abs(y)))) / (avg(pow(1 + abs(y), 0.5::DOUBLE)) + 1e-8::DOUBLE) AS point,
    0.5 * avg(pow(1 + top, 0.5::DOUBLE) * {_BASE.format('de')}) FILTER (has) / (avg(pow(1 + top, 0.5::DOUBLE)) FILTER (has) + 1e-8::DOUBLE) AS change FROM d)
  SELECT round(point, 6) AS point, round(change, 6) AS change, round(point + change, 6) AS total FROM t""",
)
def loss_sentinel(spark, d):
    return rounded(R.sentinel_loss(pairs(spark, d), "s", "k", "p", "y", alpha=1.5, beta=0.3, kappa=0.5, delta=1.0, gamma=0.5))


def _dro(source: str, out: str, loss: str, group: str = "", spread_to_blend: bool = False, floor: bool = True, keep: str = "*") -> str:
    """CTEs that add weights w to the rows of ``source`` by the logarithm of ``loss``."""
    over = f"(PARTITION BY {group})" if group else "()"
    std = f"CASE WHEN stddev_samp(lg) OVER {over} < 1e-8 THEN 0.1 ELSE coalesce(stddev_samp(lg) OVER {over}, 0.1) END" if floor else f"stddev_samp(lg) OVER {over}"
    share = "sd" if spread_to_blend else "ln(1 + sd / (abs(mn) + 1e-8::DOUBLE))"
    return f"""{out}_a AS (SELECT *, ln({loss} + 1e-8::DOUBLE) AS lg FROM {source}
), {out}_b AS (SELECT *, avg(lg) OVER {over} AS mn, {std} AS sd FROM {out}_a
), {out}_c AS (SELECT *, ln(1 + greatest(1 + (lg - mn) / greatest(sd, 0.1), 0)) AS raw, {share} AS share FROM {out}_b
), {out} AS (SELECT *, share / (share + 1) * raw / greatest(avg(raw) OVER {over}, 1e-8::DOUBLE) + 1 - share / (share + 1) AS w FROM {out}_c)"""


@query("dro_weights", f"WITH {PAIRS}, l AS (SELECT s, k, 0.5 * e * e AS l FROM pr), {_dro('l', 'q', 'l')} SELECT s, k, round(w, 5) AS w FROM q")
def dro_weights(spark, d):
    rows = pairs(spark, d).select("s", "k", (0.5 * (F.col("p") - F.col("y")) ** 2).alias("l"))
    return rounded(R.reweighted(rows, "l").select("s", "k", "w"), 5)


@query("dro_weights_by_series", f"WITH {PAIRS}, l AS (SELECT s, k, 0.5 * e * e AS l FROM pr), {_dro('l', 'q', 'l', 's')} SELECT s, k, round(w, 5) AS w FROM q")
def dro_weights_by_series(spark, d):
    rows = pairs(spark, d).select("s", "k", (0.5 * (F.col("p") - F.col("y")) ** 2).alias("l"))
    return rounded(R.reweighted(rows, "l", by=["s"]).select("s", "k", "w"), 5)


def _spectral_ctes() -> str:
    parts, names = [], []
    for n, hop in R.RESOLUTIONS:
        angle = f"2 * {pi!r}::DOUBLE * b * (k - f * {hop}) / {n}"
        hann = f"(0.5 - 0.5 * cos(2 * {pi!r}::DOUBLE * (k - f * {hop}) / {n}))"
        parts.append(f"""sp{n} AS (
  SELECT s, f, b, sum(p * {hann} * cos({angle})) AS pr_, -sum(p * {hann} * sin({angle})) AS pi_, sum(y * {hann} * cos({angle})) AS yr_, -sum(y * {hann} * sin({angle})) AS yi_
  FROM act, range({(LOSS_STEPS - n) // hop + 1}) a(f), range(1, {n // 2 + 1}) c(b) WHERE k BETWEEN f * {hop} AND f * {hop} + {n - 1} GROUP BY s, f, b
), sm{n} AS (SELECT sum({LOG_COSH.format(f'(sqrt(pr_ * pr_ + pi_ * pi_ + 1e-8::DOUBLE) - sqrt(yr_ * yr_ + yi_ * yi_))')}) / (count(*) * {n // 2 + 1} / {n // 2}.0::DOUBLE) AS m FROM sp{n})""")
        names.append(f"(SELECT m FROM sm{n})")
    return f"act AS (SELECT * FROM (SELECT s, k, p, y, max(greatest(abs(y), abs(p))) OVER (PARTITION BY s) AS t FROM pr) WHERE t > {TAU}), {', '.join(parts)}, spec AS (SELECT ({' + '.join(names)}) / {len(names)} AS spectral)"


SPECTRAL = _spectral_ctes()


@query("spectral_loss", f"WITH {PAIRS}, {SPECTRAL} SELECT round(spectral, 6) AS spectral FROM spec")
def spectral_loss(spark, d):
    return rounded(R.spectral_loss(pairs(spark, d), "s", "k", "p", "y", LOSS_STEPS, TAU))


BARRON = "((pow(2 * {0} * {0} + 1, 0.75::DOUBLE) - 1) / 3)"
CUBIC = f"({LOG_COSH} * (1 + ln(1 + abs({{0}}) * abs({{0}}) * abs({{0}}))))"
ASINH_INT = "({0} * sign({0}) * ln(abs({0}) + sqrt({0} * {0} + 1)) - sqrt({0} * {0} + 1) + 1)"
ROOT = "(sqrt({0} * {0} + 1) - 1)"
POWER = f"(pow({{0}} * {{0}} + 1e-6::DOUBLE, 0.75::DOUBLE) - {1e-6**0.75!r}::DOUBLE)"
_TOP = "greatest(abs(y), abs(p))"
_BY_SIZE = f"1 + 4 * (1 - exp(-abs(x))) * ({_TOP} / ({TAU} + {_TOP}))"
_BY_RATIO = f"1 + CASE WHEN {_TOP} > {TAU} THEN abs(x) / (1 + abs(x)) ELSE 0 END"
#: name -> (manifest name, SQL of cell, weight, level, window width (0: whole series), factor of the spectrum, delta)
FAMILIES = {
    "loss_prism": ("PrismLoss", "0.5 * x * x", f"1 + (1 - exp(-abs(x))) * (1 - exp(-{_TOP}))", None, 0, 0.3, 0.3),
    "loss_spotlight": ("SpotlightLoss", BARRON.format("x"), "1 + (1 - exp(-abs(x))) * (1 - exp(-abs(y)))", BARRON, 0, 0.3, 0.3),
    "loss_spotlight_logcosh": ("SpotlightLossLogcosh", CUBIC.format("x"), _BY_SIZE, CUBIC, max(6, LOSS_STEPS // 3), 0.025, 0.0),
    "loss_spotlight_asinh": ("SpotlightLossAsinh", ASINH_INT.format("x"), _BY_SIZE, ASINH_INT, max(6, LOSS_STEPS // 3), 0.025, 0.0),
    "loss_spotlight_huber": ("SpotlightLossHuber", ROOT.format("x"), _BY_RATIO, ROOT, max(4, LOSS_STEPS // 6), 0.3, 0.3),
    "loss_spotlight_powerlaw": ("SpotlightLossPowerLaw", f"CASE WHEN {_TOP} > {TAU} THEN {POWER.format('x')} ELSE {LOG_COSH.format('x')} END", _BY_RATIO, LOG_COSH, max(4, LOSS_STEPS // 6), 0.3, 0.3),
}


def _family_sql(name: str, cell: str, weight: str, level: str | None, width: int, factor: float) -> str:
    plain = name == "PrismLoss"
    floor = name not in ("PrismLoss", "SpotlightLoss")
    x = "e" if plain else "e - avg(e) OVER (PARTITION BY s)"
    if level is None:
        levels = "lv AS (SELECT 0.0::DOUBLE AS level)"
    elif width == 0:
        levels = f"lm AS (SELECT avg(e) AS m FROM pr GROUP BY s), lv AS (SELECT {LOSS_STEPS} * avg({level.format('m')}) AS level FROM lm)"
    else:
        levels = f"lm AS (SELECT avg(e) AS m FROM pr GROUP BY s, k // {width}), ll AS (SELECT {level.format('m')} AS l FROM lm), {_dro('ll', 'lw', 'l')}, lv AS (SELECT {LOSS_STEPS} * avg(w * l) AS level FROM lw)"
    return f"""WITH {PAIRS}, cx AS (SELECT *, {x} AS x FROM pr), cl AS (SELECT *, {cell} AS l FROM cx), {_dro('cl', 'cw', 'l', spread_to_blend=plain, floor=floor)},
  cc AS (SELECT l, w * ({weight}) AS c FROM cw), sh AS (SELECT avg(c * l) / avg(c) AS shape FROM cc), {levels}, {SPECTRAL}
  SELECT round(shape, 5) AS shape, round(level, 5) AS level, round(spectral, 5) AS spectral, round(shape + level + {factor}::DOUBLE * spectral, 5) AS total FROM sh, lv, spec"""


def _family(name: str, delta: float):
    return lambda spark, d: rounded(R.family_loss(pairs(spark, d), name, "s", "k", "p", "y", LOSS_STEPS, TAU, delta=delta), 5)


for _key, (_name, _cell, _weight, _level, _width, _factor, _delta) in FAMILIES.items():
    query(_key, _family_sql(_name, _cell, _weight, _level, _width, _factor))(_family(_name, _delta))


@query("loss_spotlight_focal", f"WITH {PAIRS}, {SPECTRAL}, m AS (SELECT avg(pow(1 - exp(-abs(e)), 2) * {LOG_COSH.format('e')}) AS main FROM pr) SELECT round(main, 5) AS main, round(spectral, 5) AS spectral, round(main + 0.3::DOUBLE * spectral, 5) AS total FROM m, spec")
def loss_spotlight_focal(spark, d):
    return rounded(R.focal_loss(pairs(spark, d), "s", "k", "p", "y", LOSS_STEPS, 2.0, 0.3, TAU), 5)


@query("level_anchor", f"WITH {PAIRS} SELECT s, (k // 8)::BIGINT AS part, round(avg(e), 6) AS mean_error FROM pr GROUP BY 1, 2")
def level_anchor(spark, d):
    rows = pairs(spark, d)
    return rounded(rows.groupBy("s", F.floor(F.col("k") / 8).alias("part")).agg(F.avg(F.col("p") - F.col("y")).alias("mean_error")))


@query("demeaned_errors", f"WITH {PAIRS} SELECT s, k, round(e - avg(e) OVER (PARTITION BY s), 6) + 0.0::DOUBLE AS shape FROM pr")
def demeaned_errors(spark, d):
    from pyspark.sql import Window

    e = F.col("p") - F.col("y")
    return rounded(pairs(spark, d).select("s", "k", (e - F.avg(e).over(Window.partitionBy("s"))).alias("shape")))


_GATES = f"""WITH RECURSIVE {PAIRS}, ls AS (SELECT s, k, e * e AS l, row_number() OVER (PARTITION BY s ORDER BY k) AS i FROM pr),
  st AS (SELECT s, k, i, l AS ema, l AS peak FROM ls WHERE i = 1
    UNION ALL SELECT s, k, i, ema, greatest(peak * 0.999::DOUBLE, ema) FROM (SELECT n.s, n.k, n.i, st.ema + 0.05::DOUBLE * (n.l - st.ema) AS ema, st.peak FROM st JOIN ls n ON n.s = st.s AND n.i = st.i + 1))
  SELECT s, k::BIGINT AS k, round(ema, 6) AS ema, round(peak, 6) AS peak, round(CASE WHEN peak < 1e-8 THEN 0.05 ELSE greatest(least(1 - ema / (peak + 1e-8::DOUBLE), 1), 0.05) END::DOUBLE, 6) AS gate FROM st"""


@query("gate_states", _GATES)
def gate_states(spark, d):
    """The curriculum gate after each step of each series, taking cells' squared errors as a log of losses."""
    rows = pairs(spark, d).select("s", "k", ((F.col("p") - F.col("y")) ** 2).alias("l"))
    return rounded(R.gates(rows, "k", "l", "s"))
