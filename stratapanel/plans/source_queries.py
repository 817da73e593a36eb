"""Panels and metrics that go through files, and sweeps of settings over a panel."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import forecast as fc
from stratapanel.operators import metrics, panel, sweeps
from stratapanel.plans.panels import MONTHLY, PARTITION, PM, STEPS, monthly
from stratapanel.plans.registry import query, rounded
from stratapanel.plans.score_queries import BASE, CELLS, GRID, _point, _shown, cells
from stratapanel.sources import tables
from stratapanel.sources.tables import shared_folder

T0, T1 = PARTITION.train


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("panel_from_file", f"WITH {PM} SELECT month_id, nation, y, n FROM pm WHERE month_id BETWEEN {T0} AND {T1}")
def panel_from_file(spark, d):
    """Writes the panel of a run type, finds and reads it by a specification without features, and slices it at the scan."""
    root = _fresh(spark, "panels")
    monthly(spark, d).write.parquet(tables.panel_path(root, "calibration"))
    read, spec = tables.read_panel(spark, replace(MONTHLY, features=()), root, "calibration")
    return panel.between(read, spec, T0, T1).select(*spec.keys, *spec.targets, *spec.features)


@query("panel_csv_copies", f"WITH {PM} SELECT month_id, nation, y, round(ln(1 + y), 6) AS logged FROM pm")
def panel_csv_copies(spark, d):
    """The panel and its copy in log space, written as CSV and read back by schema."""
    root = _fresh(spark, "copies")
    tables.write_raw_and_log(monthly(spark, d).select("month_id", "nation", "y"), "y", f"{root}/raw", f"{root}/logged")
    schema = "month_id int, nation int, y double"
    raw, logged = (tables.read_csv(spark, f"{root}/{name}", schema) for name in ("raw", "logged"))
    return raw.join(logged.select("month_id", "nation", F.round("y", 6).alias("logged")), ["month_id", "nation"])


@query("metrics_file", f"WITH {CELLS} SELECT nation, {_point()} FROM ce GROUP BY nation")
def metrics_file(spark, d):
    """Metrics of each nation, written as JSON and read back."""
    path = _fresh(spark, "metrics")
    found = metrics.metrics(cells(spark, d), ["nation"])
    tables.write_metrics(found, path)
    return _shown(tables.read_metrics(spark, path, ", ".join(f"{c} {t}" for c, t in found.dtypes)))


@query("checked_forecast", f"WITH {PM}, {BASE}, {GRID} SELECT month_id, nation, round(prediction::FLOAT::DOUBLE, 1) AS pred_y FROM gr JOIN bl USING (nation) WHERE sequence_number = 0")
def checked_forecast(spark, d):
    """Forecasts that have passed the gate before they go out."""
    points = fc.baseline_forecast(monthly(spark, d), MONTHLY, "y", PARTITION, STEPS)
    frame = fc.prediction_frame(points, MONTHLY, {"y": F.col("prediction")})
    fc.check_predictions(frame, ["pred_y"])
    return frame.select("month_id", "nation", F.round(F.col("pred_y")[0].cast("double"), 1).alias("pred_y"))


#: A blend of the value a season before with the last one, in log space, drawn towards or away from 0.
BLEND = {"season": sweeps.Range(0.0, 1.0), "shrink": sweeps.Range(0.5, 2.0, logarithmic=True), "lag": (6, 12)}
_LAGGED = f"zl AS (SELECT month_id, ln(1 + y) AS z, {', '.join(f'lag(ln(1 + y), {k}) OVER (PARTITION BY nation ORDER BY month_id) AS z{k}' for k in (1, 6, 12))} FROM pm WHERE month_id BETWEEN {T0} AND {T1})"
TRIALS = 24


def _blended(spark, d):
    order = Window.partitionBy("nation").orderBy("month_id")
    z = panel.between(monthly(spark, d), MONTHLY, T0, T1).withColumn("z", F.log1p("y"))
    return z.select("z", *(F.lag("z", k).over(order).alias(f"z{k}") for k in (1, 6, 12))).where("z12 IS NOT NULL")


def _blend_loss(s):
    back = F.when(s["lag"] == 6, F.col("z6")).otherwise(F.col("z12"))
    return F.pow(F.col("z") - s["shrink"] * (s["season"] * back + (1 - s["season"]) * F.col("z1")), F.lit(2.0))


@query(
    "random_sweep",
    f"""WITH {PM}, {_LAGGED}, u AS (SELECT t AS trial, {', '.join(f"('0x' || substr(md5('42|{c}|' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS {c}" for c in BLEND)} FROM range({TRIALS}) r(t)),
    tr AS (SELECT trial, season, exp(ln(0.5::DOUBLE) + shrink * (ln(2::DOUBLE) - ln(0.5::DOUBLE))) AS shrink, (CASE WHEN lag < 0.5 THEN 6 ELSE 12 END)::INTEGER AS lag FROM u)
    SELECT trial, round(season, 6) AS season, round(shrink, 6) AS shrink, lag, round(avg(pow(z - shrink * (season * CASE WHEN lag = 6 THEN z6 ELSE z12 END + (1 - season) * z1), 2)), 4) AS loss
    FROM tr, zl WHERE z12 IS NOT NULL GROUP BY ALL""",
)
def random_sweep(spark, d):
    """Hashed trials, all scored by one aggregate over the panel."""
    found = sweeps.scored_trials(_blended(spark, d), sweeps.draws(spark, BLEND, TRIALS, 42), BLEND, _blend_loss)
    return found.select("trial", F.round("season", 6).alias("season"), F.round("shrink", 6).alias("shrink"), "lag", F.round("loss", 4).alias("loss"))


@query("bayes_sweep")
def bayes_sweep(spark, d):
    """Eight hashed trials, then four rounds of three by expected improvement."""
    rows = _blended(spark, d)
    return rounded(sweeps.search(spark, BLEND, lambda t: sweeps.scored_trials(rows, t, BLEND, _blend_loss), 8, 4, 3, seed=42))
