import random

from tidewave.operators import graphs


def test_components_beyond_one_worker_are_moved_in_parallel(spark):
    """Small components as before, in order; those of more edges than a worker takes by parallel moves, each by itself, with every node."""
    rnd = random.Random(31)
    rows = [(a, b, 1.0) for base in (0, 1000) for a in range(base, base + 45) for b in range(a + 1, base + 45) if rnd.random() < (0.7 if (a - base) // 15 == (b - base) // 15 else 0.04)]
    small = [(2000, 2001, 1.0), (2001, 2002, 1.0), (2000, 2002, 1.0), (2002, 2003, 1.0)]
    edges = spark.createDataFrame(rows + small, "source bigint, target bigint, sim double")
    found = [tuple(r) for r in graphs.communities(edges, graphs.components(edges), most_edges=100).collect()]
    want = [(base, base + i, base + i // 15 * 15) for base in (0, 1000) for i in range(45)] + [(2000, n, c) for n, c in graphs.louvain_of(small).items()]
    assert sorted(found) == sorted(want)
