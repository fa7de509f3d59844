"""The package reaches Python workers wherever the driver runs, and tables outlive what made them."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from lectern import runtime

ROOT = str(Path(runtime.__file__).resolve().parents[1])
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from lectern import runtime
from lectern.sources import providers
s = runtime.session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
print("DIM", len(providers.embed(s.createDataFrame([("gate",)], "t string"), "t").first()["vector"]))
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert "DIM 64" in out.stdout, out.stderr[-800:]


def test_materialized_tables_and_sizes(spark):
    df = spark.range(10)
    assert runtime.materialize(df).count() == 10
    assert runtime.by_size(df, 10)
    assert not runtime.by_size(df, 9)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "local-cluster[3,4,6000]", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {"spark.checkpoint.dir": ""}

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/shared/"}
    assert runtime.shared_dir(Session()) == "hdfs://x/shared"


def test_small_and_spread(spark):
    df = spark.range(10)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(df.join(runtime.small(df), "id"))
    assert "strategy=broadcast" not in plan(df.join(runtime.small(df, 9), "id"))
    assert runtime.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 4
    assert runtime.spread(spark.range(0, 10, 1, 7)).rdd.getNumPartitions() == 7
