import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # of the driver alone
from pyspark.sql import SparkSession
from pyspark.sql.functions import lit, udf
from stratapanel.plans import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

@udf("boolean")
def sees(_):
    import importlib.util
    return importlib.util.find_spec("stratapanel") is not None

assert not spark.range(1).select(sees(lit(1))).first()[0]
for name in ("linear_forecast", "linear_forecast_samples", "scale_quantile_normal", "gate_states", "lr_plateau", "linear_forecast_covariates", "training_log", "dropout_coverage", "bayes_sweep"):
    assert len(catalog.QUERIES[name](spark, {sf!r}).collect()) > 0, name
print("all ran")
"""


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_executors_need_no_copy_of_the_package(tmp_path):
    """Python workers start in a folder without the repository, and nothing points them to it."""
    env = os.environ | {"PYSPARK_PYTHON": sys.executable}
    others = [x for x in env.pop("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != REPO]
    env |= {"PYTHONPATH": os.pathsep.join(others)} if others else {}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), sf="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
