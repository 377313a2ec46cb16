import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlstone.plans.engine import spark_session

    shared = tmp_path_factory.mktemp("shared")
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    s = spark_session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_checkpoint_dir=f"file://{shared}", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
