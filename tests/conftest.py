"""One local session for all tests."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402

from tidemark.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g", **{"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"})
    ship(s)
    yield s
    s.stop()
