"""Election queries where thousands of precincts and hundreds of maps share two boxes each: 2,500,000 pairs of equal rows, two a pair of shapes."""

import os
import time

import pytest

from tidewave.plans import marts

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import duckdb

    d = str(tmp_path_factory.mktemp("precincts"))
    c = duckdb.connect()
    for name in os.listdir(WHERE):
        t = name[:-8]
        if t == "customer":
            # Every 10,000 ids the boxes repeat.
            c.execute(f"copy (select * replace (cast(c_custkey % 2 + 10000 * k as bigint) as c_custkey) from (select *, row_number() over () as k from '{WHERE}/{name}', range(50)) where k <= 5000) to '{d}/{name}'")
        elif t == "radio_station_map":
            c.execute(f"copy (select * replace (cast(station_map_id % 2 + 10000 * k as bigint) as station_map_id) from (select *, row_number() over () as k from '{WHERE}/{name}', range(100)) where k <= 500) to '{d}/{name}'")
        else:
            os.symlink(f"{WHERE}/{name}", f"{d}/{name}")
        c.execute(f"create view {t} as select * from '{d}/{name}'")
    return d, c


@pytest.mark.parametrize("name", ["d10_votes_by_map", "d16_election_stations", "d10_votes_by_show", "d16_election_shows"])
def test_query_and_sql_agree_on_shared_boxes(spark, folder, name):
    d, c = folder
    began = time.time()
    df = marts.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    took = time.time() - began
    want = c.execute(f"select {', '.join(cols)} from ({marts.SQL[name]}) q").fetchall()
    assert want and got == sorted(map(str, want)) and took < 120


def test_crosswalk_rounds_once_a_pair_of_shapes(spark, folder):
    """d9_precinct_crosswalk; the fractions of all 2,500,000 pairs of rows were rounded, not those of the pairs of shapes."""
    d, c = folder
    df = marts.QUERIES["d9_precinct_crosswalk"](spark, d)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("round(")
    sums = "count(*) as n, count(distinct map_id) as maps, count(distinct region_id) as regions, sum(case when contained then 1 else 0 end) as inside, round(sum(fraction), 3) as fractions"
    df.createOrReplaceTempView("walk_of_precincts")
    got = spark.sql(f"select {sums} from walk_of_precincts").first()
    assert got.n > 1_000_000 and tuple(got) == c.execute(f"select {sums} from ({marts.SQL['d9_precinct_crosswalk']}) q").fetchone()


def test_votes_of_shows_take_the_maps_that_count(spark, folder, monkeypatch):
    """d16_election_shows; maps of other strengths and times never met a station's mean, but were overlapped with every precinct."""
    met, own = [], marts.geometry.weighted_by_overlap
    monkeypatch.setattr(marts.geometry, "weighted_by_overlap", lambda m, *rest: met.append(sorted(r.map_id for r in m.collect())) or own(m, *rest))
    marts.QUERIES["d16_election_shows"](spark, folder[0])
    want = folder[1].execute("select distinct station_map_id from radio_station_map where strength = 'moderate' and time_of_day in ('A', 'D', 'N') order by 1").fetchall()
    assert want and met == [[i for (i,) in want]]


def test_votes_of_stations_read_the_maps_once_after_the_overlaps(spark, folder):
    """d16_election_stations; the maps were read, cleared of repeats and joined a second time for their columns."""
    df = marts.QUERIES["d16_election_stations"](spark, folder[0])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.columns[:4] == ["map_id", "station_id", "time_of_day", "strength"] and plan.count("Relation [station_map_id") == 1
