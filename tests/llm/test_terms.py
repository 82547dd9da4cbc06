import collections
import random

from pyspark.sql import functions as F

from tidewave.llm import terms


def brute(records):
    occ, rec = collections.Counter(), collections.Counter()
    for t in records:
        w = [x for x in __import__("re").split(r"[ \t\n\r\f\v]+", (t or "").lower()) if x]
        occ.update(w)
        rec.update(set(w))
    return {k: (occ[k], rec[k]) for k in occ}


def state_of(s):
    rows = s.counts().collect()
    return {r.term: (r.n_occurrences, r.n_records) for r in rows if r.term is not None}, sum(r.n_records for r in rows if r.term is None)


def test_added_changed_and_deleted_records(spark):
    rnd = random.Random(2)
    now = {i: " ".join(rnd.choice("a b c D e' , zz\tyy".split(" ")) for _ in range(rnd.randrange(8))) for i in range(200)}
    df = lambda rows: spark.createDataFrame(rows, "src_table string, old string, new string")
    s = terms.TermCounts(spark, least_buckets=4).apply(df([("t", None, v) for v in now.values()]))
    assert state_of(s) == (brute(now.values()), 200)
    changes = []
    for i in range(0, 60):
        new = None if i % 3 == 0 else rnd.choice(["", "a a new", now[i]])
        changes.append(("t", now[i], new))
        now[i] = new
    changes.append(("t", None, "brand new"))
    now[999] = "brand new"
    s = terms.TermCounts(spark, s.path).apply(df(changes))
    alive = [v for v in now.values() if v is not None]
    assert state_of(s) == (brute(alive), len(alive))
    assert state_of(terms.TermCounts(spark, s.path)) == (brute(alive), len(alive))
    gone = s.apply(df([("t", v, None) for v in alive]))
    assert state_of(gone) == ({}, 0)


def test_empty_null_and_long(spark):
    df = lambda rows: spark.createDataFrame(rows, "src_table string, old string, new string")
    assert state_of(terms.TermCounts(spark).apply(df([]))) == ({}, 0)
    s = terms.TermCounts(spark).apply(df([("t", None, ""), ("t", None, None), ("t", None, " \n "), ("t", None, "w " * 100000), ("t", None, "É É x" + "y" * 100000)]))
    got, n = state_of(s)
    assert n == 4 and got["w"] == (100000, 1) and got["é"] == (2, 1) and len(got) == 3


def test_marks_and_versions(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (2, "a", 1), (3, "a", 9), (3, "a", 9), (4, None, 1), (None, "q", 1)] + [(i, "a c", 1) for i in range(10, 30)]
    t = spark.createDataFrame(rows, "id bigint, content string, at int").withColumn("src_table", F.lit("clash"))
    v = terms.versions(t, "id", "content", "at", F.lit(5), "t")
    s = terms.TermCounts(spark).apply(v.select("src_table", F.lit(None).cast("string").alias("old"), F.col("old").alias("new"))).apply(v.where("new is not null"))
    m = {r.term: (r.n_records, r.mark) for r in terms.marked(s.counts()).collect()}
    assert m == {"a": (23, "common"), "b": (1, "rare"), "c": (20, "common")}


def test_a_job_that_dies_leaves_the_version_before(spark, monkeypatch):
    df = lambda rows: spark.createDataFrame(rows, "src_table string, old string, new string")
    s = terms.TermCounts(spark).apply(df([("t", None, "a b"), ("t", None, "b c")]), "first")
    before = state_of(s)

    def dies(*_):
        raise KeyboardInterrupt

    broken = terms.TermCounts(spark, s.path)
    monkeypatch.setattr(broken, "_commit", dies)
    try:
        broken.apply(df([("t", "a b", None), ("t", None, "d")]), "second")
    except KeyboardInterrupt:
        pass
    again = terms.TermCounts(spark, s.path)
    assert state_of(again) == before and again.version == 1
    again.apply(df([("t", "a b", None), ("t", None, "d")]), "second").apply(df([("t", "a b", None)]), "second")
    assert state_of(terms.TermCounts(spark, s.path)) == ({"b": (1, 1), "c": (1, 1), "d": (1, 1)}, 2)


def test_buckets_grow_with_the_state(spark):
    df = lambda words: spark.createDataFrame([("t", None, " ".join(words))], "src_table string, old string, new string")
    s = terms.TermCounts(spark, bucket_rows=50, least_buckets=2).apply(df(f"w{i}" for i in range(60)))
    assert s.buckets == 2
    s = terms.TermCounts(spark, s.path, bucket_rows=50).apply(df(f"w{i}" for i in range(40, 500)))
    assert s.buckets == 16 and set(s.at) <= set(range(16))
    got, n = state_of(terms.TermCounts(spark, s.path))
    assert n == 2 and len(got) == 500 and got["w50"] == (2, 2) and got["w0"] == (1, 1)
