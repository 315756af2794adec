import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tidegauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def long(spark):
    """Long rows from (series, iso date, value) triples."""

    def make(rows):
        typed = [(s, dt.date.fromisoformat(d), None if v is None else float(v)) for s, d, v in rows]
        return spark.createDataFrame(typed, "series_id string, data date, value double")

    return make
