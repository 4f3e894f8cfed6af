import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cadastre.session import local_session

    session = local_session(cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not mounted")
    return SMALL


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


RING_TYPE = "array<struct<x:double,y:double>>"


@pytest.fixture(scope="session")
def rings(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
