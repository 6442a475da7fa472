import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tablewright.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 8, app_name="tablewright-tests")
    yield s


@pytest.fixture
def many_files(spark):
    """Keep every shuffle partition (one sorted file each) to exercise offsets."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, old)


SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
