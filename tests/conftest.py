import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from lodgecast.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(name="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def small():
    return SMALL
