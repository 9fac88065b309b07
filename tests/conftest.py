"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sievemark.session import local_session, workers_import  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=int(os.environ.get("TEST_CPUS", "4")), shuffle_partitions=4, memory="4g")
    workers_import(session, ROOT)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
