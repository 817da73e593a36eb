import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # of the driver alone
from pyspark.sql import SparkSession
from pyspark.sql.functions import lit, udf
import corpus_pipeline
from stratapanel.llm import registry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

@udf("boolean")
def sees(_):
    import importlib.util
    return importlib.util.find_spec("stratapanel") is not None

assert not spark.range(1).select(sees(lit(1))).first()[0]
docs = spark.read.parquet({sf!r} + "/documents.parquet")
for name in ("op2_language", "op3_suffix_dedup", "op4_media", "op5_token_counts", "op10_simhash"):
    assert registry.QUERIES[name](spark, {sf!r}).count() == docs.count(), name
assert corpus_pipeline.run(spark, {sf!r}).count() > 0
print("all ran")
"""


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_executors_need_no_copy_of_the_repository(tmp_path):
    """Python workers start in a folder without the repository, and nothing points them to it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    env |= {"PYTHONPATH": p} if (p := os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != REPO)) else {}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), sf="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
