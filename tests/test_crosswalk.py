"""Crosswalks of many maps and regions that share their shapes, and of boxes that touch."""

from tidewave.operators import geometry


def boxed(x0, y0, x1, y1):
    return f"POLYGON(({x0} {y0},{x1} {y0},{x1} {y1},{x0} {y1},{x0} {y0}))"


TRIANGLE = "POLYGON((0 0,2 0,0 2,0 0))"


def test_shared_shapes_are_summed_up_first(spark):
    """9,000,000 pairs, six cuts."""
    shapes = [boxed(0, 0, 2, 2), TRIANGLE]
    maps = spark.createDataFrame([(i, shapes[i % 2]) for i in range(3000)] + [(4000, boxed(50, 50, 51, 51)), (4001, None)], "map_id bigint, wkt string")
    kinds = [boxed(1, 0, 3, 1), boxed(0, 0, 1, 1), TRIANGLE]
    regions = spark.createDataFrame([(i, kinds[i % 3], i % 5) for i in range(3000)] + [(5000, None, 1)], "region_id bigint, wkt string, votes bigint")
    totals = [sum(i % 5 for i in range(k, 3000, 3)) for k in range(3)]
    got = {r.map_id: (r.n_regions, round(r.votes, 6)) for r in geometry.weighted_by_overlap(maps, regions, ["votes"]).collect()}
    want = [(3000, sum(f * t for f, t in zip(fs, totals))) for fs in ((0.5, 1.0, 1.0), (0.25, 1.0, 1.0))]
    assert got == {i: want[i % 2] for i in range(3000)}


def test_census_of_shared_shapes(spark):
    maps = spark.createDataFrame([(i, [boxed(0, 0, 2, 2), TRIANGLE][i % 2]) for i in range(2000)], "map_id bigint, wkt string")
    kinds = [boxed(1, 0, 3, 1), boxed(0, 0, 1, 1)]
    geographies = spark.createDataFrame([(i, kinds[i % 2]) for i in range(2000)] + [(5000, boxed(0, 0, 1, 1))], "geography_id bigint, wkt string")
    rows = [(i, i % 3 > 0, float(i % 4), float(i % 7), float(i % 9)) for i in range(2000)]
    wide = spark.createDataFrame(rows, "geography_id bigint, is_group boolean, population double, n double, m double")
    got = {r.map_id: tuple(round(x, 6) for x in (r.n_geos, r.population, r.n, r.m)) for r in geometry.census_by_map(maps, geographies, wide, ["n"], ["m"]).collect()}
    want = []
    for fs in ((0.5, 1.0), (0.25, 1.0)):
        part = [(fs[r[0] % 2], r) for r in rows]
        weight = sum(f * r[2] for f, r in part)
        want.append((2000, round(sum(f * r[2] for f, r in part if r[1]), 6), round(sum(f * r[3] for f, r in part), 6), round(sum(f * r[2] * r[4] for f, r in part) / weight, 6)))
    assert got == {i: want[i % 2] for i in range(2000)}


def test_boxes_are_compared_as_they_are(spark):
    """As in SQL: a side beyond another by one unit in the last place is beyond it."""
    x = 0.1 + 0.2
    maps = spark.createDataFrame([(1, boxed(x, 0, 2, 2)), (2, boxed(-1, 0, 0.3, 2))], "map_id bigint, wkt string")
    regions = spark.createDataFrame([(7, boxed(0.3, 0, 1, 1)), (8, boxed(x, 0, 1, 1))], "region_id bigint, wkt string")
    got = {(r.map_id, r.region_id): r.contained for r in geometry.crosswalk(maps, regions).collect()}
    assert got == {(1, 7): False, (1, 8): True}


def test_regions_are_read_once(spark):
    """d10_votes_by_map; each region was read, and its shape made, once for the overlaps and again for the votes."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    # POLYGON EMPTY has no bounds.
    regions = spark.createDataFrame([(i, [boxed(1, 0, 3, 1), TRIANGLE, "POLYGON EMPTY", None][i % 4], 1) for i in range(400)], "region_id bigint, wkt string, votes bigint").mapInPandas(counted, "region_id bigint, wkt string, votes bigint")
    maps = spark.createDataFrame([(1, boxed(0, 0, 2, 2)), (2, "POLYGON EMPTY"), (3, None)], "map_id bigint, wkt string")
    assert [(r.map_id, r.n_regions, round(r.votes, 6)) for r in geometry.weighted_by_overlap(maps, regions, ["votes"]).collect()] == [(1, 200, 150.0)]
    assert seen.value == 400
