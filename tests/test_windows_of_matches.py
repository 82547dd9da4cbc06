"""Match windows against a plain search, and of a long text."""

import random
import re
import time

from pyspark.sql import functions as F

from tidewave.functions import text as tx


def plain(text, query, around=2):
    if not query:
        return text
    clean = lambda t: re.sub(r"[^0-9A-Za-z'_.@% ]", "", t).lower()
    w, q = clean(text).split(" "), clean(query)
    w = [x for x in w if x]
    follows = lambda s: next((k for k, (a, b) in enumerate(zip(s, q)) if a != b), min(len(s), len(q)))
    counts = [follows(" ".join(w[i:])) for i in range(len(w))] or [0]
    at = counts.index(max(counts))
    return " ".join(w[max(at - around, 0) : at + around + 1])


def test_windows_by_plain_search(spark):
    rnd = random.Random(8)
    words = ["the", "mayor", "The", "may", "said", "say", "x", "  ", "é", "\n", "it's", "a.b", "!", "th", ""]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(9))), q) for _ in range(60) for q in ("the mayor said", "the  mayor", " the", "", "a.", "!", "it's a", "zz")]
    df = spark.createDataFrame([*rows, (None, "the"), ("a b", None)], "t string, q string")
    got = [tuple(r) for r in df.select("t", "q", tx.match_window(F.col("t"), F.col("q")).alias("w")).collect()]
    assert got == [(t, q, plain(t, q)) for t, q in rows] + [(None, "the", None), ("a b", None, "a b")]


def test_a_long_text_is_read_once(spark):
    """Work in proportion to the text; by the square of its 20,000 words it took many minutes."""
    text = "the may " * 10_000 + "over there the mayor said so it is"
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(tx.match_window(F.col("t"), F.lit("the mayor said")).alias("w")).first().w
    assert got == "over there the mayor said" and time.time() - began < 60
