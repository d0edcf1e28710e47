import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from barquet import get_spark
    s = get_spark("local[*]", 8)
    yield s


BAR_DDL = ("ISIN string, Date string, Time string, StartPrice double, MaxPrice double, "
           "MinPrice double, EndPrice double, TradedVolume bigint")


@pytest.fixture
def bars(spark):
    """Build a bar DataFrame from tuples (ISIN, Date, Time, start, max, min, end, volume)."""
    def make(rows):
        return spark.createDataFrame(rows, BAR_DDL)
    return make
