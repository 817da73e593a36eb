"""Fitted models as versioned artifacts on any file system that Spark writes to.

An artifact is a folder {run type}_{algorithm}_{timestamp} with a table of arrays, a table of
settings, and a marker that is written last: a folder without it is half written and
passed over.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.operators.forecast import LinearForecaster
from stratapanel.operators.networks import BlockNetwork
from stratapanel.operators.scaling import GroupedScaler, Scaler, scaler_from_state, scaler_state
from stratapanel.operators.training import NetworkForecaster, Optimizer
from stratapanel.sources.tables import artifact_timestamp

MARKER = "_COMPLETE"
#: Values of an array that make one row.
CHUNK = 1 << 16


def _folder(spark: SparkSession, path: str):
    """Hadoop's path and file system of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _state(model) -> tuple[dict, dict[str, np.ndarray]]:
    if model.weights is None:
        raise RuntimeError("the forecaster isn't fitted")
    if isinstance(model, LinearForecaster):
        settings = {k: getattr(model, k) for k in ("algorithm", "input_length", "output_length", "ridge", "kernel_size", "features", "static")}
        return {"kind": "linear", **settings}, {"weights": model.weights, "residuals": model.residuals}
    settings = {k: getattr(model, k) for k in ("loss", "loss_parameters", "epochs", "batch_size", "patience", "min_delta", "clip", "keep", "seed", "features", "static", "log")}
    optimizer = {k: getattr(model.optimizer, k) for k in ("name", "lr", "weight_decay", "momentum", "alpha")}
    return {"kind": "network", "network": asdict(model.network), "optimizer": optimizer, **settings}, dict(model.weights)


def _model(settings: dict, arrays: dict[str, np.ndarray]):
    settings = dict(settings)
    if settings.pop("kind") == "linear":
        model = LinearForecaster(**settings)
        model.weights, model.residuals = arrays["weights"], arrays["residuals"]
        return model
    network, log = settings.pop("network"), settings.pop("log")
    model = NetworkForecaster(BlockNetwork(**(network | {"stacks": tuple(network["stacks"])})), settings.pop("loss"), Optimizer(**settings.pop("optimizer")), **settings)
    model.weights, model.log = arrays, [tuple(x) for x in log]
    return model


def _arrays_table(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    rows = [(k, list(x.shape), i, x.ravel()[i * CHUNK : (i + 1) * CHUNK].tolist()) for k, x in arrays.items() for i in range(max(1, -(-x.size // CHUNK)))]
    return spark.createDataFrame(rows, "name string, shape array<int>, part int, cells array<double>")


def save_model(spark: SparkSession, model, root: str, run_type: str, timestamp: str, scalers: dict[str, Scaler | GroupedScaler] | None = None, manifest: dict | None = None) -> str:
    """Writes a fitted forecaster with its scalers (by role, such as "target") and manifest; returns the folder.

    ``timestamp`` has 15 characters, as in 20240131_235959.  A folder of that name is
    refused if it is complete, and written anew if it isn't.
    """
    if len(timestamp) != 15:
        raise ValueError(f"{timestamp!r} hasn't 15 characters")
    settings, arrays = _state(model)
    path = f"{root.rstrip('/')}/{run_type}_{settings.get('algorithm', 'BlockNetwork')}_{timestamp}"
    marker, fs = _folder(spark, f"{path}/{MARKER}")
    if fs.exists(marker):
        raise FileExistsError(path)
    rows = [("model", json.dumps(settings)), ("manifest", json.dumps(manifest or {})), *((f"scaler:{k}", json.dumps(scaler_state(s))) for k, s in (scalers or {}).items())]
    _arrays_table(spark, arrays).write.mode("overwrite").parquet(f"{path}/arrays")
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    fs.create(marker, False).close()
    return path


def load_model(spark: SparkSession, path: str, scaler_specs: dict | None = None) -> tuple[object, dict[str, Scaler | GroupedScaler], dict]:
    """(forecaster, scalers by role, manifest) of a complete artifact.

    ``scaler_specs`` are the configured scalers by role: one that the artifact lacks, or a
    folder without its marker, raises FileNotFoundError; one that was fitted with another
    specification raises ValueError.
    """
    marker, fs = _folder(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        raise FileNotFoundError(f"{path} isn't a complete artifact")
    settings = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/settings").collect()}
    saved = {k.partition(":")[2]: v for k, v in settings.items() if k.startswith("scaler:")}
    for role, spec in (scaler_specs or {}).items():
        if role not in saved:
            raise FileNotFoundError(f"{path} has no {role} scaler")
        if saved[role]["spec"] != json.loads(json.dumps(spec)):
            raise ValueError(f"the saved {role} scaler is {saved[role]['spec']!r}, the configured one {spec!r}")
    parts: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/arrays").orderBy("name", "part").collect():  # the network's size
        parts.setdefault(r["name"], []).append(r)
    arrays = {k: np.concatenate([np.array(r["cells"], np.float64) for r in rows]).reshape(rows[0]["shape"]) for k, rows in parts.items()}
    return _model(settings["model"], arrays), {k: scaler_from_state(v) for k, v in saved.items()}, settings["manifest"]


def latest_model(spark: SparkSession, root: str, run_type: str) -> str:
    """The complete artifact of a run type with the latest timestamp."""
    folder, fs = _folder(spark, root)
    names = [s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory()] if fs.exists(folder) else []
    complete = [(artifact_timestamp(n), n) for n in names if n.rpartition("/")[2].startswith(f"{run_type}_") and fs.exists(_folder(spark, f"{n}/{MARKER}")[0])]
    if not complete:
        raise FileNotFoundError(f"no complete artifact of {run_type} in {root}")
    return max(complete)[1]


def artifact_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, cells) of an artifact's arrays."""
    return spark.read.parquet(f"{path}/arrays").groupBy("name", "shape").agg(F.sum(F.size("cells")).alias("cells"))
