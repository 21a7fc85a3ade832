import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegauge import session  # noqa: E402

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    session.local_work_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return TESTDATA
