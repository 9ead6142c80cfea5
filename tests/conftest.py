import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from loomspark.session import get_session, ship


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def root():
    if not os.path.isdir(SF):
        pytest.skip("the test tables aren't here")
    return SF
