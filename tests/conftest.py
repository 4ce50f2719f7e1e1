from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from civicflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one column expression over a list of inputs named ``c``."""

    def run(expression, inputs, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
        return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return run
