import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import ODD_ROWS, SF, documents_of  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return documents_of(spark, ODD_ROWS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents_of(spark, [])


@pytest.fixture(scope="session")
def sf():
    return SF
