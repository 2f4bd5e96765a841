import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sievework.session import build_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    return session


@pytest.fixture
def small_tasks(spark):
    """Pretend that a task holds 40 rows, so that every ordered group is cut into slices."""
    spark.conf.set("sievework.rowsPerTask", "40")
    yield spark
    spark.conf.unset("sievework.rowsPerTask")
