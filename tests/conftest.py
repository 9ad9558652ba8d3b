import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from regatta.session import get_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")
