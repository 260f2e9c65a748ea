import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from wirelens.plans.traffic import Traffic  # noqa: E402
from wirelens.schemas import LOGS, PACKETS  # noqa: E402
from wirelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def traffic(spark):
    def make(packets, logs=None):
        p = spark.createDataFrame(packets, PACKETS)
        return Traffic(p, None if logs is None else spark.createDataFrame(logs, LOGS))

    return make
