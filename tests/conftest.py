import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fairlead.session import build_session

    return build_session("local[4]", shuffle_partitions=4)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tables(spark):
    from fairlead.bindings import Bindings

    return Bindings(spark, SF)
