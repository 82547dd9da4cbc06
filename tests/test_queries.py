"""Every query that has SQL gives the rows the SQL gives, on the smallest tables."""

import glob
import os

import pytest

from tidewave.plans import registry

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{WHERE}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"
    if getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_and_sql_agree(spark, duck, name):
    df = registry.QUERIES[name](spark, WHERE)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.execute(f"select {quoted} from ({registry.SQL[name]}) q").fetchall()
    got = df.select(*cols).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
