import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_data import SCHEMA, awkward_rows  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    frame = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in ("fp", "key", "h", "curve", "_doc", "part", "score", "kept", "rep", "piece", "block", "tail"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
