import random

from tidewave.llm import truncation

SCHEMA = "id bigint, body string, long_body string, object_body string, source string, truncated string"


def found(spark, rows):
    out = truncation.judged(spark.createDataFrame(rows, SCHEMA), "id", "body", "source", "long_body", "object_body")
    return {r.id: r.truncated for r in out.collect()}


def corpus():
    rnd = random.Random(7)
    verbs, nouns = ["funded", "reviewed", "closed"], ["school", "harbor", "bridge", "council"]
    full = lambda: f"The mayor {rnd.choice(verbs)} the {rnd.choice(nouns)} this week and nobody will {rnd.choice(['review', 'close'])} it"
    return [(i, full() + rnd.choice([".", ".", "", "!", " #news", "…"]), None, None, "web", None) for i in range(400)]


def test_endings(spark):
    rows = corpus()
    cases = {
        1000: ("The mayor funded the school this week and nobody", True), 1001: ("The mayor funded the school this week and nobo", True), 1002: ("The mayor funded the bri�", True), 1003: ("The mayor closed it &am", True),
        1004: ("The mayor funded the school this week and nobody will review it", False), 1005: ("The mayor closed the harbor this week and nobody will close it…", False), 1006: ("The mayor funded the school. Great!", False),
        1007: ("The mayor funded the school this week and nobody… https://t.example/abc", True), 1008: ("Well, R&D", False),
    }
    rows += [(k, b, None, None, "web", None) for k, (b, _) in cases.items()]
    rows += [(2000, "It stopped.", "It stopped. Then it went on.", None, "web", None), (2001, "The mayor funded the", "The mayor funded the", None, "web", None), (2002, "Done…", None, "Done and dusted", None, None)]
    got = found(spark, rows + rows[:50])
    assert {k: got[k] for k in cases} == {k: t for k, (_, t) in cases.items()}
    assert got[2000] is True and got[2001] is False and got[2002] is True
    assert sum(got[i] for i in range(400)) == 0 and len(got) == 412


def test_a_limit_shows_in_the_lengths(spark):
    rows = corpus() + [(3000 + i, f"Word{i % 7} " * 20 + "end of the line" [: 15], None, None, "bot", None) for i in range(40)]
    rows = [(i, (b[:100] if s == "bot" else b), lo, o, s, x) for i, b, lo, o, s, x in rows]
    got = found(spark, rows)
    assert all(got[3000 + i] for i in range(40))


def test_empty_null_and_long(spark):
    assert found(spark, []) == {}
    got = found(spark, [(1, None, None, None, "a", None), (2, "", None, None, "a", None), (3, "word " * 30000, None, None, None, None), (None, "x", None, None, "a", None), (4, "…", None, None, "a", None), (5, "   ", None, None, "a", None), (6, "it's {curly} 'quoted' \\", None, None, "a", None)])
    assert set(got) == {3, 4, 5, 6}
