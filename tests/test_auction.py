import random

import numpy as np

from tidewave.operators import stories

SCHEMA = "left bigint, right bigint, weight double"


def test_the_total_is_the_greatest(spark):
    rnd = random.Random(31)
    rows = [(i, j, float(rnd.randrange(-2, 12))) for i in range(9) for j in range(7) if rnd.random() < 0.6]
    w = np.zeros((9, 7))
    for i, j, x in rows:
        w[i, j] = x
    want = sum(w[i, j] for i, j in stories.assignment(w))
    got = stories.auction_matching(spark.createDataFrame(rows + rows[:5] + [(None, 1, 3.0)], SCHEMA), slack=0.1).collect()
    assert sum(r.weight for r in got) == want and len({r.left for r in got}) == len({r.right for r in got}) == len(got) and all(r.weight > 0 for r in got)


def test_no_pairs(spark):
    assert stories.auction_matching(spark.createDataFrame([(1, 1, 0.0)], SCHEMA)).count() == 0
