import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import build_session

    session = build_session("tests", master="local[4]", shuffle_partitions=4,
                            extra={"spark.driver.memory": "6g", "spark.ui.enabled": "false",
                                   "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
