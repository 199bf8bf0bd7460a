from __future__ import annotations

import os
import subprocess
import sys

import pytest

from hourgrid import session

PLAIN = """
from pyspark.sql import SparkSession
from hourgrid.session import drop_stages, shared_folder, staged
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
table = staged(spark.range(5))
assert shared_folder(spark) == shared_folder(spark) and table.count() == 5
assert drop_stages(spark) == 1 and drop_stages(spark) == 0
print("staged", shared_folder(spark))
"""


def test_stages_in_a_plain_local_session(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    run = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not os.path.exists(run.stdout.split()[-1]), "the folder goes with the process"


class Remote:
    """A session of a cluster, as far as the folder is concerned."""

    def __init__(self, **settings):
        self.settings, self.conf, self.sparkContext, self.master = settings, self, self, "spark://host:7077"

    def get(self, key, default=None):
        return self.settings.get(key, default)


@pytest.mark.parametrize("settings", [{}, {session.STAGE_KEY: "/tmp/x"}, {session.STAGE_KEY: "file:///tmp/x"}])
def test_a_cluster_needs_a_shared_folder(settings):
    with pytest.raises(ValueError):
        session.shared_folder(Remote(**settings))


def test_a_named_shared_folder_is_taken():
    assert session.shared_folder(Remote(**{session.STAGE_KEY: "hdfs://nn/x"})) == "hdfs://nn/x"
    assert session.shared_folder(Remote(**{"spark.checkpoint.dir": "file:///shared"})) == "file:///shared"
