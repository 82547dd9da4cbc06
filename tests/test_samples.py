"""Samples of the source's sizes."""

import os

import pytest

from tidewave.plans import warehouse

WHERE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables here")


def test_a_day_holds_up_to_200_station_pairs(spark):
    per_day = [r["count"] for r in warehouse.d14_station_pairs(spark, WHERE).groupBy("date").count().collect()]
    assert 20 < max(per_day) <= 200
