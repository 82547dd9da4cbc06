"""Small cases of the operators that SQL cannot check."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import text as tx
from tidewave.operators import geometry, graphs, segments, series, stats, stories, vectors
from tidewave.sources import files


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a in g for b in g if a < b] + [(0, 10, 1.0)]
    want = {n: 0 for n in range(5)} | {n: 10 for n in range(10, 15)}
    assert graphs.louvain_of(e) == want
    df = spark.createDataFrame(e, "source bigint, target bigint, sim double")
    got = graphs.communities(df, graphs.components(df))
    assert {r.node: r.community for r in got.collect()} == want
    m = graphs.modularity(df, got).first()
    assert m.modularity == pytest.approx(20 / 21 - 0.5) and m.coverage == pytest.approx(20 / 21)
    with pytest.raises(Exception, match="too large"):
        graphs.communities(df, graphs.components(df), most_edges=3).collect()


def test_components_and_paths(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)]
    df = spark.createDataFrame(chain, "source bigint, target bigint")
    assert {r.component for r in graphs.components(df).collect()} == {0, 100}
    assert graphs.components(df.limit(0)).count() == 0
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "source bigint, target bigint")
    b = {r.node: r.betweenness for r in graphs.betweenness(star).collect()}
    assert b[0] == 6.0 and b[1] == 0.0
    s = {(r.a, r.b): r.score for r in graphs.simrank(star, 3).collect()}
    assert s[1, 2] == pytest.approx(0.9)


def test_assignment_is_best():
    rnd = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(30):
        n, m = rnd.integers(1, 5), rnd.integers(1, 6)
        w = rnd.normal(0.3, 1, (n, m))
        got = stories.assignment(w)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        wide = np.hstack([np.maximum(w, 0), np.zeros((n, n))])
        best = max(sum(wide[i, p[i]] for i in range(n)) for p in permutations(range(wide.shape[1]), int(n)))
        assert sum(w[i, j] for i, j in got) == pytest.approx(best)


def test_distributions():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.f_upper(4.965, 1, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.chi2_upper(3.8415, 1) == pytest.approx(0.05, abs=1e-4) and stats.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228, abs=1e-3)


def test_regression_and_clusters(spark):
    rnd = np.random.default_rng(2)
    rows = [(int(i % 8), float(x), float(3 + 2 * x + (i % 8) + rnd.normal())) for i, x in enumerate(rnd.normal(size=400))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    fit = {r.term: r for r in stats.least_squares(df, ["x"], "y", cluster="g", fixed="g").collect()}
    assert fit["x"].coef == pytest.approx(2, abs=0.2) and 0 < fit["x"].se < 0.3 and fit["x"].p < 1e-4
    x, y = np.array([[1, r[1]] for r in rows]), np.array([r[2] for r in rows])
    b, res, *_ = np.linalg.lstsq(x, y, rcond=None)
    plain = {r.term: r for r in stats.least_squares(df, ["x"], "y").collect()}
    se = math.sqrt(res[0] / 398 * np.linalg.inv(x.T @ x)[1, 1])
    assert plain["x"].coef == pytest.approx(b[1]) and plain["x"].se == pytest.approx(se)
    m = stats.mann_whitney(df.withColumn("s", F.when(F.col("g") < 4, "a").otherwise("b")), "s", "a", "b", "y").first()
    assert m.p < 1e-6


def test_series():
    rnd = np.random.default_rng(3)
    noise = rnd.normal(size=600)
    walk = np.cumsum(noise)
    assert series.unit_root(noise)[2] and not series.unit_root(walk)[2]
    ar = np.zeros(3000)
    for i in range(1, 3000):
        ar[i] = 0.7 * ar[i - 1] + rnd.normal()
    p = series.partial_autocorrelation(ar, 3)
    assert p[1] == pytest.approx(0.7, abs=0.06) and abs(p[2]) < 0.07 and series.autocorrelation(ar, 2)[2] == pytest.approx(0.49, abs=0.08)
    x = rnd.normal(size=500)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.3 * rnd.normal(size=500)
    v = series.Autoregression(np.column_stack([x, y]), 2)
    assert v.causes(1, 0)[1] < 1e-10 and v.causes(0, 1)[1] > 0.001
    assert v.responses(3).shape == (4, 2, 2) and v.whiteness(8)[1] > 1e-4 and v.normality()[1] > 1e-4


def test_geometry(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert geometry.hull_of([*square, (1.0, 1.0), (1.0, 0.0)]) == square
    assert geometry.areas_of([square], [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]) == pytest.approx((4, 4, 1, True))
    hole = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    assert geometry.area_of(hole) == pytest.approx(15) and geometry.areas_of(hole, [square])[2] == pytest.approx(3)
    bowtie, notch = [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]], [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]]
    assert geometry.areas_of(hole, bowtie) == pytest.approx((15, 2, 1.5, False)) and geometry.areas_of(notch, [square]) == pytest.approx((10, 4, 11 / 3, True))
    maps = spark.createDataFrame([(1, "POLYGON((0 0,2 0,2 2,0 2,0 0))"), (2, None), (3, "POINT(1 1)")], "map_id bigint, wkt string")
    regions = spark.createDataFrame([(7, "POLYGON((1 1,3 1,3 3,1 3,1 1))"), (8, "POLYGON((0.5 0.5,1 0.5,1 1,0.5 0.5))"), (9, "POLYGON((5 5,6 5,6 6,5 5))")], "region_id bigint, wkt string")
    got = {r.region_id: r for r in geometry.crosswalk(maps, regions).collect()}
    assert set(got) == {7, 8} and got[7].fraction == pytest.approx(0.25) and not got[7].contained and got[8].contained and got[8].fraction == 1
    pts = spark.createDataFrame([(1, x, y) for x, y in [*square, (1.0, 1.0)]], "g int, x double, y double")
    assert geometry.hulls(pts, ["g"], "x", "y").first().wkt == "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"


def test_silence_and_diarization(spark):
    words = [("a", 0.0, 0.2), ("b", 0.3, 0.5), ("c", 0.6, 0.8), ("d", 0.9, 1.0), ("e", 1.1, 1.2), ("<sil>", 1.3, 1.4), ("f", 2.0, 2.1), ("g", 5.0, 5.1)]
    assert segments.silence_segments(words) == [("a b c d e", 0.0), ("f g", 2.0)]
    w = spark.createDataFrame([("k", t, s, e, 0.5 if t != "b" else None) for t, s, e in words], "audio_key string, word string, start double, stop double, confidence double")
    d = spark.createDataFrame([("k", 0.0, 0.6, "S1"), ("k", 0.5, 2.0, "S2"), ("k", 3.0, 4.0, "S1")], "audio_key string, segment_start double, segment_end double, spk string")
    out = [(r.segment_idx, r.content, round(r.mean_word_confidence, 3), r.spk) for r in segments.by_diarization(w, d).orderBy("segment_idx").collect()]
    assert out == [(0, "a b", 0.25, "S1"), (1, "c d e <sil>", 0.5, "S2"), (2, "", -1.0, "S1")]


def test_text_functions(spark):
    df = spark.createDataFrame([("n._p._r.'s white_house said hello.",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.display_text(F.col("t"))).collect()] == ["NPR's white house said Hello.", "", None]
    show = tx.DisplayForms({"new york": "New York", "obama": "Obama", "bad": "Too Many"})
    assert show.text("obama in new york <unk> u._s. white_house") == "Obama in New York ... US white house"
    assert tx.acronyms_of("the f b i and u._s.'s [noise] white_house") == "the FBI and US's white house"
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(tx.normal_form(F.lit("NPR News, Inc"))) == "n._p._r. news inc"
    assert v(tx.degrees(F.lit("42-30-00 S"))) == -42.5 and v(tx.degrees(F.lit("x"))) is None
    assert v(tx.match_window(F.lit("a b the mayor said c d e"), F.lit("the mayor left"))) == "a b the mayor said"
    assert v(tx.match_window(F.lit("A, b's c"), F.lit(""))) == "A, b's c" and v(tx.match_window(F.lit("one two three four"), F.lit("zzz"))) == "one two three"
    assert v(tx.join_phrases(F.lit("a health board b radio group"), [("health", "board"), ("radio", "group")])) == "a health_board b radio_group"
    assert v(tx.reference_text(F.lit("JANE DOE: Hi [laughs] there (ph).\nJOE: Yes: so\nCopyright © 2020 X\nmore"))) == "Hi there . Yes: so"
    assert v(tx.effect_type(F.lit(0.01), F.lit(0.2))) == "T -> R" and v(tx.effect_type(F.lit(0.01), F.lit(0.02))) == "T <-> R" and v(tx.effect_type(F.lit(0.3), F.lit(0.2))) == "Neither"
    assert v(tx.facet_display(F.lit("state_code=MA"), {"MA": "Massachusetts"})) == "Massachusetts"
    assert v(tx.log_odds(F.lit(0.5))) == 0 and v(tx.log_odds(F.lit(1.0))) is None


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n{"a": 2}\n')
    bad = files.bad_json_lines(spark, str(tmp_path / "in")).collect()
    assert [(r.line_no, r.text) for r in bad] == [(2, "broken")]
    with pytest.raises(ValueError):
        files.bad_json_lines(spark, str(tmp_path / "in"), stop=True)
    good = files.read_json_lines(spark, str(tmp_path / "in"), "a int, b string")
    assert sum(r._corrupt is None for r in good.collect()) == 2
    df = spark.createDataFrame([(1, 'q "u", o'), (2, None)], "n int, t string")
    files.write_delimited(df, str(tmp_path / "csv"))
    back = files.read_delimited(spark, str(tmp_path / "csv"), "n int, t string")
    assert sorted(map(tuple, back.collect()), key=str) == [(1, 'q "u", o'), (2, None)]
    lines = spark.createDataFrame([(json.dumps({"x": 1, "y": 2}),), ('{"x": 3, "z": 4}',)], "j string")
    with pytest.raises(ValueError):
        files.json_lines_to_columns(lines, "j")
    assert spark.range(1).select(files.without_keys(F.lit('{"a":"1","b":"2"}'), ["a"])).first()[0] == '{"b":"2"}'
    k = F.lit("raw/out/2018-03-03/WXYZ/15_50_48.raw")
    assert spark.range(1).select(files.key_station(k), files.key_timestamp(k)).first()[:] == ("WXYZ", "2018-03-03 15:50:48")
    w = spark.range(1).select(files.words_of_tsv(F.lit("a\t0.1\t0.2\nbad\nb\t1\t2"))).first()[0]
    assert [(x.word, x.start) for x in w] == [("a", 0.1), ("b", 1.0)]


def test_similarity_edges_in_tiles(spark):
    rnd = random.Random(4)
    rows = [("e", i, rnd.choice([0.0, 4000.0, 15999.0, 16000.0, rnd.uniform(0, 40000)]), [rnd.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "kind string, id bigint, t double, v array<double>")
    limit = spark.createDataFrame([("e", 1.0)], "kind string, threshold double")
    want = {(a[1], b[1]) for a in rows for b in rows if (a[2], a[1]) < (b[2], b[1]) and b[2] <= (a[2] // 4000 + 4) * 4000 and sum(x * y for x, y in zip(a[3], b[3])) >= 1.0}
    for cell in (7, 1000):
        got = [(r.source, r.target) for r in vectors.similarity_edges(df, ["kind"], "id", "t", "v", limit, cell_rows=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_sentence_vectors(spark):
    t = spark.createDataFrame([(i, w) for i in range(4) for w in ("a", "b")[: i % 2 + 1]], "s bigint, token string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    assert vectors.sentence_vectors(t, "s", "token", v).count() == 4


def test_streaming_ticks(spark, tmp_path):
    from tidewave.streaming.ticks import stream_ticks

    df = spark.createDataFrame([("a", 1, "2024-01-01 00:10:00"), ("a", 2, "2024-01-01 00:50:00"), ("b", 3, "2024-01-01 05:00:00")], "k string, v int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    s = stream_ticks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["v"], "1 hour", ["k"])
    q = s.writeStream.format("memory").queryName("ticks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.n, r.v) for r in spark.table("ticks").collect()}
    assert ("a", 2, 3) in got
