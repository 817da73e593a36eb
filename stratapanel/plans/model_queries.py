"""Forecasters with covariates, saved models, gradient steps and trained networks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratapanel.functions.elementary import asinh
from stratapanel.operators import batches, metrics, panel, windows
from stratapanel.operators.forecast import LinearForecaster
from stratapanel.operators.networks import BlockNetwork
from stratapanel.operators.training import NetworkForecaster, Optimizer
from stratapanel.plans.panels import INPUTS, MONTHLY, PARTITION, PM, STEPS, monthly
from stratapanel.plans.registry import query, rounded
from stratapanel.sources import artifacts
from stratapanel.sources.tables import shared_folder
from stratapanel.spec import PanelSpec

T0, T1 = PARTITION.train
S0, S1 = PARTITION.test
SEQUENCES = PARTITION.origins(STEPS)
#: The monthly panel with the log of its target, and the number of orders as a covariate.
LOGGED = PanelSpec("month_id", "nation", ("z",), ("n",))
ZM = f"{PM}, zm AS (SELECT month_id, nation, n::DOUBLE AS n, ln(1 + y) AS z FROM pm)"


def logged(spark, d):
    return monthly(spark, d).withColumn("z", F.log1p("y"))


def levels(pm):
    return panel.between(pm, LOGGED, T0, T1).groupBy("nation").agg(F.avg("z").alias("level"))


def _covariate_model(pm, static):
    """Two steps ahead from the last value, the orders of its month, and the nation's mean."""
    return LinearForecaster("NLinearModel", 1, 2, features=("n",), static=("level",)).fit(pm, LOGGED, "z", PARTITION.train, static)


def _shown(found):
    return found.select("nation", "sequence_number", "step", "month_id", F.round(F.col("pred_z")[0].cast("double"), 3).alias("prediction"))


_REGRESSORS = ("n", "s", "1")


def _solved(k: int) -> str:
    """Cramer's rule for three ridge coefficients of step k from the sums of products."""
    a = [[f"(s{min(i, j)}{max(i, j)}{' + 1' if i == j else ''})" for j in range(3)] for i in range(3)]
    b = [f"b{i}{k}" for i in range(3)]

    def determinant(m):
        terms = [(0, 1, 2, "+"), (1, 2, 0, "+"), (2, 0, 1, "+"), (2, 1, 0, "-"), (1, 0, 2, "-"), (0, 2, 1, "-")]
        return "(" + " ".join(f"{sign} {m[0][x]} * {m[1][y]} * {m[2][z]}" for x, y, z, sign in terms) + ")"

    return ", ".join(f"{determinant([[b[i] if j == c else a[i][j] for j in range(3)] for i in range(3)])} / {determinant(a)} AS w{c}{k}" for c in range(3))


COVARIATES = f"""WITH {ZM}, lv AS (SELECT nation, avg(z) AS s FROM zm WHERE month_id BETWEEN {T0} AND {T1} GROUP BY nation),
w AS (SELECT nation, n, s, lead(z, 1) OVER o - z AS y1, lead(z, 2) OVER o - z AS y2 FROM zm JOIN lv USING (nation) WHERE month_id BETWEEN {T0} AND {T1} WINDOW o AS (PARTITION BY nation ORDER BY month_id)),
g AS (SELECT {', '.join(f'sum({_REGRESSORS[i]} * {_REGRESSORS[j]})::DOUBLE AS s{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum({_REGRESSORS[i]} * y{k}) AS b{i}{k}' for i in range(3) for k in (1, 2))} FROM w WHERE y2 IS NOT NULL),
c AS (SELECT {_solved(1)}, {_solved(2)} FROM g)
SELECT nation, (month_id - {S0 - 1})::INTEGER AS sequence_number, k::INTEGER AS step, (month_id + k)::INTEGER AS month_id,
  round(greatest(z + CASE WHEN k = 1 THEN w01 * n + w11 * s + w21 ELSE w02 * n + w12 * s + w22 END, 0)::FLOAT::DOUBLE, 3) AS prediction
FROM zm JOIN lv USING (nation), c, range(1, 3) r(k) WHERE month_id BETWEEN {S0 - 1} AND {S0 + SEQUENCES - 2}"""


@query("linear_forecast_covariates", COVARIATES)
def linear_forecast_covariates(spark, d):
    pm = logged(spark, d)
    static = levels(pm)
    return _shown(_covariate_model(pm, static).predict(pm, LOGGED, "z", S0, SEQUENCES, static=static))


@query("saved_forecast", COVARIATES)
def saved_forecast(spark, d):
    """Fits, saves, finds the latest complete artifact, loads it and forecasts."""
    pm = logged(spark, d)
    static = levels(pm)
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    artifacts.save_model(spark, _covariate_model(pm, static), root, "calibration", "20240131_120000", manifest={"steps": 2})
    model, _, _ = artifacts.load_model(spark, artifacts.latest_model(spark, root, "calibration"))
    return _shown(model.predict(pm, LOGGED, "z", S0, SEQUENCES, static=static))


@query(
    "covariate_windows",
    f"""WITH {ZM}, w AS (SELECT nation, month_id AS start, list(z) OVER f AS z, list(n) OVER f AS n FROM zm WHERE month_id BETWEEN {T0} AND {T1}
  WINDOW f AS (PARTITION BY nation ORDER BY month_id ROWS BETWEEN CURRENT ROW AND {INPUTS + STEPS - 1} FOLLOWING))
  SELECT nation, start, len(z[1:{INPUTS}])::INTEGER AS inputs, round(list_sum(z[{INPUTS + 1}:]), 4) AS outputs, round(list_sum(n[1:{INPUTS}]), 4) AS past_n, round(list_sum(list_transform(z[1:{INPUTS}], lambda v: 2 * v)), 4) AS past_z
  FROM w WHERE len(z) = {INPUTS + STEPS}""",
)
def covariate_windows(spark, d):
    found = windows.training_windows(logged(spark, d).withColumn("twice", 2 * F.col("z")), LOGGED, "z", INPUTS, STEPS, time_range=PARTITION.train, features=("n", "twice"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    of = lambda k: total(F.filter("past", lambda v, i: i % 2 == k))
    return rounded(found.select("nation", "start", F.size("inputs").alias("inputs"), total("outputs").alias("outputs"), of(0).alias("past_n"), of(1).alias("past_z")), 4)


BATCH = 64


@query(
    "epoch_batches",
    f"""WITH {PM}, w AS (SELECT nation, month_id AS start, count(*) OVER (PARTITION BY nation ORDER BY month_id ROWS BETWEEN CURRENT ROW AND {INPUTS + STEPS - 1} FOLLOWING) AS k FROM pm WHERE month_id BETWEEN {T0} AND {T1}),
    e AS (SELECT nation, start, x::INTEGER AS epoch, (row_number() OVER (PARTITION BY x ORDER BY md5('7|' || x || '|' || nation || '|' || start)) - 1) // {BATCH} AS batch, count(*) OVER (PARTITION BY x) AS total FROM w, range(2) r(x) WHERE k = {INPUTS + STEPS})
    SELECT nation, start, epoch, batch::INTEGER AS batch FROM e WHERE batch < total // {BATCH}""",
)
def epoch_batches(spark, d):
    """Two epochs of training windows in batches of 64, another order in each; a shorter last batch is left out."""
    rows = windows.training_windows(monthly(spark, d), MONTHLY, "y", INPUTS, STEPS, time_range=PARTITION.train).select("nation", "start")
    first, second = (batches.epoch_batches(rows, ["nation", "start"], BATCH, e, seed=7).withColumn("epoch", F.lit(e)) for e in range(2))
    return first.unionByName(second)


_RATE = 0.001


@query(
    "gradient_step",
    f"""WITH {ZM}, w AS (SELECT z AS x0, lead(z, 1) OVER o AS x1, n AS x2, lead(n, 1) OVER o AS x3, 1 AS x4, lead(z, 2) OVER o AS y FROM zm WHERE month_id BETWEEN {T0} AND {T1} WINDOW o AS (PARTITION BY nation ORDER BY month_id)),
    v AS ({' UNION ALL '.join(f'SELECT {i} AS i, avg(x{i} * y) AS a FROM w WHERE y IS NOT NULL' for i in range(5))})
    SELECT i::INTEGER AS position, round({2 * _RATE} * a, 6) AS weight FROM v""",
)
def gradient_step(spark, d):
    """The weights of a linear network after one step of gradient descent from 0: two inputs, a covariate at both, a bias."""
    model = NetworkForecaster(BlockNetwork(2, 1, features=1, stacks=("linear",)), "MSELoss", Optimizer("SGD", _RATE), epochs=1, keep="last", features=("n",))
    weights = model.fit(logged(spark, d), LOGGED, "z", PARTITION.train).weights
    cells = [*weights["0.forecast"].ravel().tolist(), *weights["0.bias"].tolist()]
    return rounded(spark.createDataFrame(list(enumerate(cells)), "position int, weight double"))


def _trained(pm, static):
    """A doubly residual network of a trend, a seasonal and a generic stack on asinh of the target."""
    network = BlockNetwork(INPUTS, STEPS, features=1, static=1, stacks=("trend", "seasonality", "generic"), layers=2, width=16, dropout=0.1, from_last=True)
    fit, (low, high), _ = PARTITION.validation(INPUTS, STEPS)
    model = NetworkForecaster(network, "SmoothL1Loss", Optimizer("AdamW", 0.01, 1e-3), {"beta": 1.0}, epochs=6, patience=3, clip=1.0, seed=3, features=("x",), static=("level",))
    return model.fit(pm, SCALED, "z", fit.train, (low, high), static)


SCALED = PanelSpec("month_id", "nation", ("z",), ("x",))


def scaled(spark, d):
    pm = monthly(spark, d)
    return pm.select("month_id", "nation", asinh(F.col("y")).alias("z"), asinh(F.col("n")).alias("x"), "y")


@query("training_log")
def training_log(spark, d):
    """Losses of each epoch of the network, and which epoch's weights were the best by then."""
    pm = scaled(spark, d)
    return rounded(_trained(pm, levels(pm)).log_table(spark), 4)


@query("block_forecast")
def block_forecast(spark, d):
    pm = scaled(spark, d)
    static = levels(pm)
    return _trained(pm, static).predict(pm, SCALED, "z", S0, SEQUENCES, static=static)


@query("dropout_coverage")
def dropout_coverage(spark, d):
    """Coverage, interval score and CRPS of samples that drop units, over all test cells."""
    pm = scaled(spark, d)
    static = levels(pm)
    found = _trained(pm, static).predict(pm, SCALED, "z", S0, SEQUENCES, num_samples=20, mc_dropout=True, seed=5, static=static)
    cells = found.join(pm.select("nation", "month_id", F.col("z").alias("y")), ["nation", "month_id"])
    return rounded(metrics.sample_metrics(cells, "pred_z").select("coverage", "mis", "crps"), 4)
