import random

from pyspark.sql import functions as F

from tidewave.operators import graphs


def quality(spark, edges, labels):
    return graphs.modularity(edges, labels, "sim").first().modularity


def test_planted_communities_are_found(spark):
    rnd = random.Random(21)
    rows = {}
    for a in range(60):
        for b in range(a + 1, 60):
            if rnd.random() < (0.6 if a // 15 == b // 15 else 0.03):
                rows[a, b] = 1.0
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "source bigint, target bigint, sim double")
    found = graphs.moved_communities(edges)
    assert {r.node: r.community for r in found.collect()} == {a: a // 15 * 15 for a in range(60)}


def test_modularity_comes_near_that_of_moves_in_turn(spark):
    rnd = random.Random(22)
    rows = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(110)) if a != b} | {(100, 101), (101, 102)})
    edges = spark.createDataFrame([(a, b, 0.5 + (a * b) % 3) for a, b in rows], "source bigint, target bigint, sim double")
    in_turn = graphs.louvain_of([tuple(r) for r in edges.collect()])
    best = quality(spark, edges, spark.createDataFrame(list(in_turn.items()), "node bigint, community bigint"))
    found = graphs.moved_communities(edges)
    assert found.count() == len(in_turn) and quality(spark, edges, found) > 0.9 * best
    assert found.groupBy("community").agg(F.min("node").alias("m")).where("m <> community").isEmpty()


def test_no_edges(spark):
    assert graphs.moved_communities(spark.createDataFrame([], "source bigint, target bigint, sim double")).count() == 0
