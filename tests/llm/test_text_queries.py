"""The text queries that have SQL give its rows; the others run whole and keep their columns."""

import glob
import os

import pytest

from tidewave.llm import queries

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables here")

COLUMNS = {
    "p1_found": ["src_table", "term", "mark"], "p5_found": ["src_table", "keep_id", "copy_id"], "p6_found": ["audio_key", "turn_no", "speaker_no", "first_snippet_id", "n_words"],
    "p7_found": ["activity_id", "generator_name"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "other_doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, WHERE)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name in COLUMNS:
        assert len(rows) == len(set(rows))
    if name in queries.SQL:
        c = duckdb.connect()
        for p in glob.glob(f"{WHERE}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        want = c.execute(f"select {', '.join(df.columns)} from ({queries.SQL[name]}) q").fetchall()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
