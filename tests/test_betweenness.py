import random

import pytest

from tidewave.operators import graphs


def test_by_joins_equals_by_adjacency(spark):
    rnd = random.Random(12)
    edges = spark.createDataFrame([(rnd.randrange(25), rnd.randrange(25)) for _ in range(45)] + [(100, 101), (101, 102)], "source bigint, target bigint")
    held = {r.node: r.betweenness for r in graphs.betweenness(edges).collect()}
    for rows in (10**9, 300):
        joined = {r.node: r.betweenness for r in graphs.betweenness(edges, most_edges=0, origin_rows=rows).collect()}
        assert joined == pytest.approx(held)
    assert held[101] == 1 and held[100] == 0
