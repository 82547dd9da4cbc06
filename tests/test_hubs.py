import pytest

from tidewave.operators import graphs


def test_hubs_that_share_one_neighbour(spark):
    edges = [(i, 1000) for i in range(100)] + [(i, 1001) for i in range(99, 199)]
    df = spark.createDataFrame(edges, "source bigint, target bigint")
    assert [tuple(r) for r in graphs.simrank(df, 2).collect()] == [(1000, 1001, pytest.approx(0.9 / 100 / 100))]
    assert graphs.simrank(df, 2, least=1e-4).count() == 0
