"""Training diagnostics, with events standing in for a training log, and schedules."""

from __future__ import annotations

from math import pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratapanel.operators import diagnostics, schedules
from stratapanel.plans.panels import table
from stratapanel.plans.registry import query, rounded
from stratapanel.sources import generators

#: A run is a user; its batches are the user's events in order; an epoch is a day.
LOG = "lg AS (SELECT user_id, event_id, value, event_type, (datediff('day', DATE '1980-01-01', ts::DATE) + 1)::INTEGER AS epoch FROM events)"


def log(spark, d):
    from stratapanel.functions.calendar import day_id

    return table(spark, d, "events").select("user_id", "event_id", "value", "event_type", day_id(F.col("ts")).alias("epoch"))


@query(
    "rolling_loss_spikes",
    f"WITH {LOG} SELECT user_id, event_id, round(avg(value) OVER w, 9) AS rolling_mean, count(value) OVER w AS seen, coalesce(count(value) OVER w >= 10 AND value > 5 * avg(value) OVER w, false) AS is_spike FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)",
)
def rolling_loss_spikes(spark, d):
    return rounded(diagnostics.loss_spikes(log(spark, d), "user_id", "event_id", "value").select("user_id", "event_id", "rolling_mean", "seen", "is_spike"), 9)


@query("loss_stability", f"WITH {LOG} SELECT epoch, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS low, max(value) AS high, round(stddev_pop(value) / abs(avg(value)), 4) AS cv, stddev_pop(value) / abs(avg(value)) > 0.5 AS unstable FROM lg GROUP BY epoch")
def loss_stability(spark, d):
    return rounded(diagnostics.loss_stability(log(spark, d), ["epoch"], "value"), 4)


_RUNS = f"{LOG}, fl AS (SELECT *, event_type = 'error' AS bad FROM lg), il AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM fl), rl AS (SELECT *, sum(bad::INTEGER) OVER (PARTITION BY user_id, island ORDER BY event_id) AS run_length FROM il)"


@query("nan_runs", f"WITH {_RUNS} SELECT user_id, event_id, run_length::BIGINT AS run_length FROM rl")
def nan_runs(spark, d):
    rows = log(spark, d).withColumn("bad", F.col("event_type") == "error")
    return diagnostics.runs_of(rows, "user_id", "event_id", "bad").select("user_id", "event_id", "run_length")


@query("nan_patience", f"WITH {_RUNS} SELECT user_id, min(event_id) AS stopped_at FROM rl WHERE run_length >= 3 GROUP BY user_id")
def nan_patience(spark, d):
    rows = log(spark, d).withColumn("bad", F.col("event_type") == "error")
    return diagnostics.patience(rows, "user_id", "event_id", "bad", 3)


_EPOCHS = f"{LOG}, ep AS (SELECT user_id, epoch, sum(value::DECIMAL(18,2))::DOUBLE AS seconds FROM lg GROUP BY 1, 2)"


@query("epoch_eta", f"WITH {_EPOCHS} SELECT user_id, epoch, round(avg(seconds) OVER w, 8) AS mean_seconds, round((30 - count(*) OVER w) * avg(seconds) OVER w, 7) AS remaining_seconds FROM ep WINDOW w AS (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)")
def epoch_eta(spark, d):
    rows = log(spark, d).groupBy("user_id", "epoch").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("seconds"))
    out = diagnostics.epoch_timing(rows, "user_id", "epoch", "seconds", 30)
    return out.select("user_id", "epoch", F.round("mean_seconds", 8).alias("mean_seconds"), F.round("remaining_seconds", 7).alias("remaining_seconds"))


@query(
    "human_durations",
    f"WITH {_EPOCHS}, s AS (SELECT user_id, epoch, floor(seconds * 10)::BIGINT AS s FROM ep) SELECT user_id, epoch, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS duration FROM s",
)
def human_durations(spark, d):
    rows = log(spark, d).groupBy("user_id", "epoch").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("seconds"))
    return rows.select("user_id", "epoch", diagnostics.human_duration(F.col("seconds") * 10).alias("duration"))


_NORMS = f"{LOG}, nm AS (SELECT user_id, sqrt(sum(value * value)) AS norm, count(*) AS n, count(*) FILTER (value = 0) AS zero FROM lg GROUP BY user_id)"


@query("layer_norms", f"WITH {_NORMS} SELECT user_id, round(norm, 4) AS norm, 0::BIGINT AS nan, 0::BIGINT AS inf, zero, n FROM nm")
def layer_norms(spark, d):
    return rounded(diagnostics.layer_norms(log(spark, d), "user_id", "value"), 4)


@query("norm_summary", f"WITH {_NORMS} SELECT round(min(norm), 4) AS low, round(max(norm), 4) AS high, round(avg(norm), 4) AS mean, round(quantile_cont(norm, 0.5), 4) AS median, count(*) FILTER (norm < 1e-7) AS vanishing, count(*) FILTER (norm > 500) AS exploding, 0::BIGINT AS nan, 0::BIGINT AS inf FROM nm")
def norm_summary(spark, d):
    return rounded(diagnostics.norm_summary(diagnostics.layer_norms(log(spark, d), "user_id", "value")), 4)


@query("norm_offenders", f"WITH {_NORMS} SELECT user_id, round(norm, 4) AS norm FROM nm WHERE norm > 100 ORDER BY nm.norm DESC, user_id LIMIT 3")
def norm_offenders(spark, d):
    return rounded(diagnostics.offenders(diagnostics.layer_norms(log(spark, d), "user_id", "value"), "user_id", 100).select("user_id", "norm"), 4)


@query("last_batch_of_epoch", f"WITH {LOG} SELECT user_id, epoch, max_by(value, event_id) AS value, max(event_id) AS event_id FROM lg GROUP BY 1, 2")
def last_batch_of_epoch(spark, d):
    return diagnostics.last_of_epoch(log(spark, d), ["user_id", "epoch"], "event_id", "value")


@query("top_timelines", f"WITH {LOG} SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM lg GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10")
def top_timelines(spark, d):
    return log(spark, d).groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).orderBy(F.desc("total"), "user_id").limit(10)


@query("sampled_entities", f"WITH {LOG} SELECT lg.* FROM lg JOIN (SELECT user_id FROM (SELECT DISTINCT user_id FROM lg) ORDER BY md5('42|' || user_id), user_id LIMIT 10) USING (user_id)")
def sampled_entities(spark, d):
    return diagnostics.sampled_entities(log(spark, d), "user_id", 10, 42)


@query(
    "weighted_means",
    f"WITH {LOG} SELECT epoch, round(sum(event_id * value) / sum(event_id), 4) AS weighted FROM lg GROUP BY epoch",
)
def weighted_means(spark, d):
    return rounded(log(spark, d).groupBy("epoch").agg((F.sum(F.col("event_id") * F.col("value")) / F.sum("event_id")).alias("weighted")), 4)


@query("lr_warmup_cosine", f"SELECT e AS epoch, round(CASE WHEN e < 10 THEN 1e-6::DOUBLE + (0.001::DOUBLE - 1e-6::DOUBLE) * e / 10 ELSE 1e-6::DOUBLE + (0.001::DOUBLE - 1e-6::DOUBLE) * (1 + cos({pi!r}::DOUBLE * least((e - 10) / 290.0::DOUBLE, 1))) / 2 END, 9) AS lr FROM range(320) t(e)")
def lr_warmup_cosine(spark, d):
    return rounded(schedules.warmup_cosine(spark, 320, 0.001), 9)


@query(
    "lr_warmup_restarts",
    f"SELECT e AS epoch, round(CASE WHEN e < 5 THEN 0.001::DOUBLE * e / 5 WHEN e < 35 THEN 0.0005::DOUBLE * (1 + cos({pi!r}::DOUBLE * (e - 5) / 30)) WHEN e < 95 THEN 0.0005::DOUBLE * (1 + cos({pi!r}::DOUBLE * (e - 35) / 60)) ELSE 0.0005::DOUBLE * (1 + cos({pi!r}::DOUBLE * (e - 95) / 120)) END, 9) AS lr FROM range(200) t(e)",
)
def lr_warmup_restarts(spark, d):
    return rounded(schedules.warmup_restarts(spark, 200, 0.001), 9)


@query("lr_step", "SELECT e AS epoch, round(0.01::DOUBLE * pow(0.5::DOUBLE, e // 30), 9) AS lr FROM range(100) t(e)")
def lr_step(spark, d):
    return rounded(schedules.step_decay(spark, 100, 0.01, 30, 0.5), 9)


@query("lr_exponential", "SELECT e AS epoch, round(0.01::DOUBLE * pow(0.95::DOUBLE, e), 9) AS lr FROM range(100) t(e)")
def lr_exponential(spark, d):
    return rounded(schedules.exponential_decay(spark, 100, 0.01, 0.95), 9)


_PLATEAU = f"""WITH RECURSIVE {LOG}, ep AS (SELECT user_id, epoch, avg(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS i FROM lg GROUP BY 1, 2),
  st AS (SELECT DISTINCT user_id, 0::INTEGER AS epoch, 0::BIGINT AS i, 'infinity'::DOUBLE AS best, 0 AS bad, 0.01::DOUBLE AS lr FROM ep
    UNION ALL SELECT user_id, epoch, i, CASE WHEN better THEN v ELSE best END, CASE WHEN better OR bad + 1 > 3 THEN 0 ELSE bad + 1 END, CASE WHEN NOT better AND bad + 1 > 3 THEN greatest(lr * 0.5::DOUBLE, 1e-5::DOUBLE) ELSE lr END
    FROM (SELECT e.user_id, e.epoch, e.i, e.v, st.best, st.bad, st.lr, e.v < st.best * (1 - 1e-4::DOUBLE) AS better FROM st JOIN ep e ON e.user_id = st.user_id AND e.i = st.i + 1))
  SELECT user_id, epoch::BIGINT AS epoch, round(lr, 12) AS lr FROM st WHERE i > 0"""


@query("lr_plateau", _PLATEAU)
def lr_plateau(spark, d):
    rows = log(spark, d).groupBy("user_id", "epoch").agg(F.avg("value").alias("v"))
    return rounded(schedules.plateau(rows, "user_id", "epoch", "v", 0.01, 0.5, 3, 1e-5), 12)


@query("grid_expansion", "SELECT a.x AS lr, b.x AS batch_size, c.x AS dropout FROM (VALUES ('0.001'), ('0.0003')) a(x), (VALUES ('32'), ('64'), ('128')) b(x), (VALUES ('0.1'), ('0.3')) c(x)")
def grid_expansion(spark, d):
    return schedules.grid(spark, {"lr": [0.001, 0.0003], "batch_size": [32, 64, 128], "dropout": [0.1, 0.3]})


@query("random_trials")
def random_trials(spark, d):
    return schedules.random_draws(spark, {"lr": [0.001, 0.0003], "batch_size": [32, 64, 128]}, 20, 42)


@query("generated_panel")
def generated_panel(spark, d):
    return generators.clustered_panel(spark)


@query("generated_gamma")
def generated_gamma(spark, d):
    return generators.zero_inflated_gamma(spark, 5000)


@query("generated_batch")
def generated_batch(spark, d):
    return generators.fake_batch(spark, 64, 36, 3)


@query("generated_experiment")
def generated_experiment(spark, d):
    """The baseline on the generated panel: split, fit, score."""
    from stratapanel.operators import forecast as fc
    from stratapanel.operators import metrics, panel
    from stratapanel.spec import PanelSpec

    spec = PanelSpec("time", "country_id", ("target",))
    parts = panel.split_by_position(generators.clustered_panel(spark), spec)
    fitted = fc.log_mean_baseline(parts.where("is_train"), spec, "target")
    held_out = parts.where("not is_train").join(fitted, "country_id").select(F.col("prediction").alias("p"), F.col("target").alias("y"))
    return rounded(metrics.metrics(held_out))


@query("series_ranks", f"WITH {LOG} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS batch FROM lg")
def series_ranks(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id")
    return log(spark, d).select("user_id", "event_id", F.row_number().over(order).cast("long").alias("batch"))
