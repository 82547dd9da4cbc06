import random

from pyspark.sql import functions as F

from tidewave.operators import skew

SCHEMA = "id bigint, a bigint, b bigint, who string, secs double, extra string"


def brute(rows):
    once = {}
    for r in rows:
        if r[0] is not None:
            once.setdefault(r[0], r)
    out = {}
    for i, a, b, who, secs, _ in once.values():
        for name, v in (("a", a), ("b", b)):
            n, s, w = out.setdefault((name, v), [0, 0, set()])
            out[name, v] = [n + 1, s + int(round((secs or 0) * 1000)), w | ({who} if who is not None else set())]
    return {k: (n, len(w), s) for k, (n, s, w) in out.items()}


def run(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA)
    out = skew.totals_by_key(df, "id", ["a", "b"], "who", {"ms": F.round(F.col("secs") * 1000)}, parts)
    return {(r.key_name, r.key_value): (r.n_rows, r.n_distinct, r.ms) for r in out.collect()}


def test_one_key_holds_most_rows(spark):
    rnd = random.Random(1)
    rows = [(i, 1 if rnd.random() < 0.7 else rnd.randrange(2, 30), rnd.choice([None, 5, 6]), rnd.choice(["x", "y", None, "", "z" * 50]), rnd.random(), "e") for i in range(3000)]
    rows += rows[:200]
    for parts in (1, 7):
        assert run(spark, rows, parts) == brute(rows)


def test_all_null_empty_and_single(spark):
    assert run(spark, [], 3) == {}
    rows = [(1, None, None, None, None, None), (None, 3, 3, "x", 1.0, None)]
    assert run(spark, rows, 3) == {("a", None): (1, 0, 0), ("b", None): (1, 0, 0)}


def test_a_label_on_both_sides_of_every_boundary(spark):
    rows = [(i, 7, 7, "same", 1.0, None) for i in range(500)]
    assert run(spark, rows, 9) == {("a", 7): (500, 1, 500000), ("b", 7): (500, 1, 500000)}


def test_heavy_keys(spark):
    rows = [(i, 1 if i < 50 else i, None, None, 0.0, None) for i in range(100)]
    out = skew.heavy_keys(skew.totals_by_key(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], "who", {}), "a", 0.04)
    assert [(r.key_name, r.key_value) for r in out.collect()] == [("a", 1)]


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(100)] + [(None, 999)], "k int, l int")
    right = spark.createDataFrame([(i % 4, i) for i in range(20)] + [(None, 5)], "k int, r int")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, skew.salted_join(left, right, ["k"], F.lit(True), hot_rows=5).collect())) == want


def test_salted_join_cuts_both_sides(spark):
    left = spark.createDataFrame([(0, i) for i in range(60)] + [(1, 1)], "k int, l int")
    right = spark.createDataFrame([(0, i) for i in range(45)] + [(1, i) for i in range(50)], "k int, r int")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, skew.salted_join(left, right, ["k"], F.lit(True), hot_rows=10).collect())) == want
