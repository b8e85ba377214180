import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postpulse import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    extra = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    session = build_session("tests", "local[8]", 4, extra)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def values(df, column=None):
    """All rows as tuples, or one column as a list, in no particular order."""
    rows = df.collect()
    return [r[column] for r in rows] if column else [tuple(r) for r in rows]
