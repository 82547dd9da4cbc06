from tidewave.operators import graphs


def test_paths_beyond_thirty_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(34)], "source bigint, target bigint")
    start = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.distance for r in graphs.distances(chain, start).collect()} == {i: i for i in range(35)}
