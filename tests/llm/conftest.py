import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def made():
    return cases.rows()


@pytest.fixture(scope="session")
def docs(spark, made):
    return cases.frame(spark, made)


@pytest.fixture(scope="session")
def empty(spark):
    return cases.frame(spark, [])
