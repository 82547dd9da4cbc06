import numpy as np
import pytest

from tidewave.operators import stats


def test_parts_together_are_one_resample(spark):
    """Means of resamples scatter like means of samples: by the deviation over the root of the number, whatever the number of parts."""
    rnd = np.random.default_rng(8)
    n = 120
    values = rnd.normal(size=(n, 3)) + [0.0, 1.0, 5.0]
    df = spark.createDataFrame([("a", s, p, float(values[s, p])) for s in range(n) for p in range(3)], "side string, story int, point int, value double")
    for part_rows in (10_000, 25):
        sims = np.array([r.curve for r in stats.resampled_means(df, "side", 2000, part_rows=part_rows).orderBy("sim").collect()])
        assert sims.shape == (2000, 3)
        assert sims.mean(0) == pytest.approx(values.mean(0), abs=0.02) and sims.std(0) == pytest.approx(values.std(0) / np.sqrt(n), rel=0.08)


def test_a_constant_stays_itself_and_differences_show(spark):
    rows = [(k, s, p, v) for k, v in (("a", 1.0), ("b", 2.0)) for s in range(7) for p in range(2)]
    df = spark.createDataFrame(rows, "side string, story int, point int, value double")
    sims = stats.resampled_means(df, "side", 50, part_rows=3)
    assert {(r.side, tuple(np.round(r.curve, 9))) for r in sims.collect()} == {("a", (1.0, 1.0)), ("b", (2.0, 2.0))}
    assert {(r.point, r.p) for r in stats.bootstrap_p(sims, "side", "a", "b").collect()} == {(0, 0.0), (1, 0.0)}
    assert stats.resampled_means(df.where("false"), "side", 5).count() == 0
