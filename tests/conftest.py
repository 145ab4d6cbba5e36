import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from checks.runall import session
    from shopfloor.session import tune

    s = tune(session())
    s.conf.set("spark.sql.maxMetadataStringLength", 10000)  # whole filter lists in plan texts
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from checks.runall import connect

    return connect(SF_DIR)


@pytest.fixture(scope="session")
def data(spark):
    from checks.queries import data_for

    return data_for(spark, SF_DIR)


@pytest.fixture
def frame(spark):
    """frame(ddl, rows) -> DataFrame"""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)
