import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlstone.session import session

    top = tmp_path_factory.mktemp("spark")
    spark = session("4", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.local.dir": str(top / "local"), "spark.sql.warehouse.dir": str(top / "warehouse"),
        "spark.checkpoint.dir": f"file://{top}/shared", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
