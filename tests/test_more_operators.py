"""Readers and functions that no query reaches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import series, stats
from tidewave.sources import files


def test_transcripts_parts_and_listing(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps({"segments": [{"text": " one "}, {"text": "two"}]}))
    (tmp_path / "t/b.json").write_text("{broken")
    assert [r.text for r in files.read_transcripts(spark, str(tmp_path / "t")).collect()] == ["one two"]
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path / "t")).collect()] == ["a.json", "b.json"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/2021-1.csv").write_text("n\n1\n2\n")
    (tmp_path / "p/2022-1.csv").write_text("n\n3\n")
    assert sorted(r.n for r in files.read_parts(spark, str(tmp_path / "p"), "n int", "2022-").collect()) == [1, 2]


def test_injected_records_are_cut_out(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a"<<info>>: 2}'), (3, "bad"), (4, None)], "i int, j string")
    assert sorted((r.i, r.a) for r in files.clean_json_lines(rows, "j", "<<[^>]*>>", "a int").collect()) == [(1, 1), (2, 2)]


def test_impulse_responses(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=300)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.1 * rnd.normal(size=300)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g string, t int, x double, y double")
    got = {(r.shock, r.response, r.period): r.value for r in series.impulse_responses(df, "g", "t", ["x", "y"], 1, 2).collect()}
    assert len(got) == 12 and got["x", "y", 1] == pytest.approx(0.8, abs=0.12) and abs(got["y", "x", 1]) < 0.2


def test_scaling_keeps_plane_distances():
    d = np.zeros((6, 6))
    d[:3, :3] = d[3:, 3:] = 1.0
    p = stats.classical_scaling(d)
    far = lambda a, b: float(np.linalg.norm(p[a] - p[b]))
    assert far(0, 1) < 0.05 and far(0, 4) == pytest.approx(np.sqrt(6), abs=0.05)


def test_rank_helpers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    assert sorted((r.v, r.rank) for r in stats.average_ranks(df, [], "v").where(F.col("v").isNotNull()).collect()) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5)]


def test_mean_intervals(spark):
    """Half widths by Student's t: 2.776 standard errors for five values, 12.706 for two."""
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", 1.0), ("b", 3.0), ("c", 7.0), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r.mean, r.half) for r in stats.mean_intervals(df, ["g"], "v").collect()}
    assert got["a"] == (5, 3.0, pytest.approx(2.776 * np.sqrt(0.5), abs=1e-3)) and got["b"][2] == pytest.approx(12.706, abs=1e-2) and got["c"] == (1, 7.0, None)


def test_matrices_and_batches(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert files.read_matrix(str(tmp_path / "m.npy")).to_pylist() == [{"id": i, "embedding": [2.0 * i, 2.0 * i + 1]} for i in range(3)]
    batches = list(files.sampled_batches(spark.range(1000), "id", 0.3, 64))
    ids = [r.id for b in batches for r in b]
    assert all(len(b) == 64 for b in batches[:-1]) and 200 < len(ids) == len(set(ids)) < 400
    assert ids == [r.id for b in files.sampled_batches(spark.range(1000), "id", 0.3, 64) for r in b]


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(2)
    rows = [("a", float(v), int(w)) for v, w in zip(rnd.integers(0, 50, 400), rnd.integers(0, 4, 400))] + [("b", 1.0, 1), ("c", None, 1), (None, 3.0, 2), (None, 5.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    for weight in (None, "w"):
        got = {r.g: r.quantiles for r in stats.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], weight).collect()}
        values = [v for g, v, w in rows if g == "a" for _ in range(w if weight else 1)]
        assert got["a"] == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))) and got["b"] == [1.0] * 5 and "c" not in got
        assert got[None] == pytest.approx([3, 3, 3, 4.6, 5] if weight else [3, 3.5, 4, 4.8, 5])


def test_streams_and_tables(spark, tmp_path, capsys):
    for name in ("a.txt", "a.txt.gz"):
        with files.text_stream(str(tmp_path / name), write=True) as f:
            f.write("é\n")
        with files.text_stream(str(tmp_path / name)) as f:
            assert f.read() == "é\n"
    with files.text_stream("-", write=True) as f:
        f.write("out")
    assert capsys.readouterr().out == "out"
    spark.sql("drop table if exists tidewave_t")
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    assert files.create_table_as(df, "tidewave_t", ["k"]).count() == 5
    with pytest.raises(Exception, match="already exists"):
        files.create_table_as(df, "tidewave_t")
    files.truncate_table(spark, "tidewave_t")
    assert spark.table("tidewave_t").count() == 0 and set(spark.table("tidewave_t").columns) == {"id", "k"}
    spark.sql("drop table tidewave_t")
