import collections
import random

from pyspark.sql import functions as F

from tidewave.llm import copies


def brute(rows):
    once = {}
    for i, c in rows:
        if i is not None and c is not None:
            once[i] = min(c, once.get(i, c))
    g = collections.defaultdict(list)
    for i, c in once.items():
        g[c].append(i)
    return {(min(v), i) for v in g.values() for i in v if i != min(v)}


def test_radix_levels_and_a_hot_text(spark):
    rnd = random.Random(4)
    hot = "samebeginning" + "x" * 300
    texts = [hot] * 400 + ["samebeginning" + "x" * rnd.randrange(60) for _ in range(300)] + ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(300)] + ["", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, hot), (None, "q")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, canon string")
    for limit in (20, 150, 100000):
        got = [(r.keep_id, r.copy_id) for r in copies.copy_pairs(df, bucket_rows=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    kept = {r.keep_id: r.n_copies for r in copies.collapsed(df, bucket_rows=50).collect()}
    assert sum(kept.values()) == 1002 and kept[0] == 400


def test_empty_table(spark):
    assert copies.copy_pairs(spark.createDataFrame([], "id bigint, canon string")).count() == 0


def test_letters_and_digits(spark):
    df = spark.createDataFrame([("Ab-c 1\n’É_ß",), ("",), (None,), ("!" * 100000,)], "t string")
    assert [r[0] for r in df.select(copies.letters_and_digits(F.col("t"))).collect()] == ["abc1éß", "", None, ""]


def test_json_forms():
    c = copies.canonical_json
    assert c('{"a": "X y!", "b": 1.0}') == c('{"b":1e0 , "a":"xY"}')
    assert c('{"a": 1}') != c('{"a": "1"}') and c('{"a": 1}') != c('{"a": 1.5}') and c('{"a": true}') != c('{"a": 1}')
    assert c('{"a": [1, {"z": 2, "y": null}]}') == c('{"a": [1.0, {"y": null, "z": 2}]}')
    assert c("[1]") is None and c("{bad") is None and c(None) is None and c("") is None
