"""Shared folders, with and without a configured one."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from usageloom.session import shared_dir

ROOT = Path(__file__).parents[1]
PLAIN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from usageloom.session import cut_lineage, shared_dir
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert sorted(r[0] for r in cut_lineage(spark.range(3)).collect()) == [0, 1, 2]
assert shared_dir(spark) == shared_dir(spark.newSession())
print("works in", shared_dir(spark))
"""


def test_lineage_is_cut_on_a_plain_local_session(tmp_path):
    """No configuration folder, so no spark.checkpoint.dir."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    out = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert out.returncode == 0 and "works in" in out.stdout, out.stderr[-2000:]


class _Session:
    def __init__(self, **conf):
        self.conf = conf


def test_a_configured_folder_is_used_and_a_cluster_needs_one():
    assert shared_dir(_Session(**{"spark.checkpoint.dir": "s3://bucket/x", "spark.master": "yarn"})) == "s3://bucket/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session(**{"spark.master": "spark://host:7077"}))
