"""Queries over whole tables, where SQL does not check them."""

import base64
import hashlib

import pytest

from tidewave.operators import graphs
from tidewave.plans import analysis

WHOLE = ["f21_approxhash_chars", "j8_within_days", "j10_overlapping", "o7_mutual", "n5_components", "g7_strong_components", "g12_pagerank", "g15_distances", "g1_follow_graph", "g2_followers_of_several", "g4_friends_of_followers", "g18_dyads"]
EDGES = [(500 + i, i % 7) for i in range(60)] + [(900, 3), (900, 4)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Ids beyond every bound of the queries on parts of the tables."""
    d = str(tmp_path_factory.mktemp("tables"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("orders", [(i, s, "P") for i, (s, _) in enumerate(EDGES)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    write("lineitem", [(i, t) for i, (_, t) in enumerate(EDGES)], "l_orderkey bigint, l_suppkey bigint")
    write("embeddings", [(i,) for i in range(700)], "vec_id bigint")
    write("documents", [(1, "plain Text"), (2, "é Ä İ\U0001f600 a s\n"), (3, ""), (4, None)], "doc_id bigint, text string")
    return d


def chars_hash(text):
    return base64.b64encode(hashlib.md5(" ".join(x.lower().strip() for x in text if x not in "aistdmoy").encode()).digest()).decode()


def test_all_are_registered():
    assert set(WHOLE) <= set(analysis.QUERIES) and set(WHOLE) - set(analysis.SQL) == {"f21_approxhash_chars"}


def test_hashes_beyond_ascii(spark, tables):
    got = {r.doc_id: r.hash for r in analysis.f21_approxhash_chars(spark, tables).collect()}
    assert got == {i: chars_hash(t) for i, t in spark.read.parquet(f"{tables}/documents.parquet").collect() if t is not None}


def test_communities_hold_every_node(spark, tables):
    want = graphs.louvain_of([(t, s, 1.0) for s, t in sorted(EDGES, key=lambda e: (e[1], e[0]))])
    assert {r.node: r.community for r in analysis.n7_communities(spark, tables).collect()} == want


def test_ring_scores_hold_every_vector(spark, tables):
    joined = {n for i in range(700) if i != (i * 7 + 3) % 500 for n in (i, (i * 7 + 3) % 500)}
    assert {r.node for r in analysis.g11_betweenness(spark, tables).collect()} == joined
