from pyspark.sql import functions as F

from tidewave.llm import copies


def test_hot_texts_of_several_levels_are_spread(spark):
    """Each hot text goes to as many parts as its rows need, at the level where it becomes one text; no bucket is above the limit by more than chance."""
    texts = ["a" * 8] * 400 + ["b" * 16] * 900 + ["b" * 16 + "c"] * 3 + ["d" * 300] * 250 + [f"{i:08d}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, canon string")
    out = copies._bucketed(rows, 100, 10**9)
    per = {r.canon: (r.n, r.parts, r.hot) for r in out.groupBy("canon").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("parts"), F.max("hot").alias("hot")).collect()}
    assert per["a" * 8] == (400, 4, True) and per["b" * 16] == (900, 9, True) and per["d" * 300] == (250, 3, True) and per["b" * 16 + "c"] == (3, 1, False)
    assert out.count() == len(texts) and out.groupBy("bucket").count().agg(F.max("count")).first()[0] < 160


def test_buckets_are_limited_in_characters(spark):
    rows = spark.createDataFrame([(i, "same" * 5 + chr(97 + i % 26) + "y" * 5000) for i in range(260)], "id bigint, canon string")
    out = copies._bucketed(rows, 10**6, 60_000)
    assert out.groupBy("bucket").agg(F.sum(F.length("canon")).alias("c")).agg(F.max("c")).first()[0] < 120_000
    assert {(r.keep_id, r.copy_id) for r in copies.copy_pairs(rows, bucket_rows=10**6, bucket_chars=60_000).collect()} == {(i % 26, i) for i in range(26, 260)}
