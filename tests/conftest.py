import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ranqa.session import get_session

    active = SparkSession.getActiveSession()
    s = active or get_session(master="local[8]", shuffle_partitions=8)
    yield s
