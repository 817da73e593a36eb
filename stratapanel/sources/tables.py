"""Readers, writers and artifact lookup; all paths may be on any file system that Spark knows."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.operators import audit
from stratapanel.spec import PanelSpec


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one in spark.checkpoint.dir, or a throw-away one in local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, True)
    return made


def panel_path(root: str, run_type: str, stem: str = "panel", extension: str = ".parquet") -> str:
    return f"{root.rstrip('/')}/{run_type}_{stem}{extension}"


def read_panel(spark: SparkSession, spec: PanelSpec, root: str | None = None, run_type: str | None = None, cached_path: str | None = None, stem: str = "panel") -> tuple[DataFrame, PanelSpec]:
    """The panel of a run type, or of an explicit path, with its schema checked; features default to the rest."""
    path = cached_path or panel_path(root, run_type, stem)
    panel = read_csv(spark, path, None) if path.endswith(".csv") else spark.read.parquet(path)
    if not spec.features:
        spec = spec.with_features_of(panel.columns)
    audit.check_schema(panel, spec)
    return panel, spec


def read_csv(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    """CSV with a header; a schema spares the pass that infers one."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_raw_and_log(panel: DataFrame, column: str, raw: str, logged: str) -> None:
    """The panel, and its copy with log1p of one column, as CSV."""
    write_csv(panel, raw)
    write_csv(panel.withColumn(column, F.log1p(column)), logged)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Metrics of a JSON folder; without a schema, a metric that is null in all rows has no column."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def latest_artifact(spark: SparkSession, root: str, run_type: str) -> str:
    """The path of a run type's artifact whose name ends in the latest 15-character timestamp."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().toString() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    stems = [(artifact_timestamp(n), n) for n in names if n.rstrip("/").rpartition("/")[2].startswith(run_type)]
    if not stems:
        raise FileNotFoundError(f"no artifact of {run_type} in {root}")
    return max(stems)[1]


def artifact_timestamp(path: str) -> str:
    """The last 15 characters of a name without its extension, as in 20240131_235959."""
    stem = re.sub(r"\.[A-Za-z]\w*$", "", path.rstrip("/").rpartition("/")[2])
    return stem[-15:]
