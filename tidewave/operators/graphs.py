"""Graphs as edge tables: components, centrality, triangles, communities, projections."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.storage import materialize, release


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once as source < target, without loops."""
    e = edges.where("source is not null and target is not null and source <> target")
    return e.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of the undirected graph, by alternating large-star and small-star steps.

    A step links every node's larger (then smaller) neighbours to the smallest node around; the rounds needed grow with the logarithm of
    the longest path. Each round is written to the shared folder. Raises rather than return unfinished labels."""
    e = materialize(undirected(edges), "edges")
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    # Nodes read the first table; each round's table is deleted once the next is written.
    first = e
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select("target", "source"))
        low = both.groupBy("source").agg(F.min("target").alias("m")).withColumn("m", F.least("m", "source"))
        large = both.join(low, "source").where(F.col("target") > F.col("source")).select(F.col("target").alias("source"), F.col("m").alias("target"))
        large = large.where("source <> target").distinct()
        # Small star: a node's smaller neighbours, and itself, to the smallest of them.
        down = large.select(F.greatest("source", "target").alias("source"), F.least("source", "target").alias("target"))
        least = down.groupBy("source").agg(F.min("target").alias("m"))
        small = down.join(least, "source").where("target <> m").select(F.col("target").alias("source"), F.col("m").alias("target")).union(least.select("source", F.col("m").alias("target")))
        before, e = e, materialize(small.distinct(), "edges")
        if before is not first:
            release(before)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("source", "target").cast("decimal(38,0)"))).first()
        if last is not None and tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("source").alias("node"), "target"), "node", "left").groupBy("node").agg(F.min(F.coalesce("target", "node")).alias("component"))


def large_components(labels: DataFrame, least: int) -> DataFrame:
    """Members of components with at least `least` nodes."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "component")


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree of distinct directed edges."""
    e = edges.select("source", "target").distinct()
    return e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out_degree")).join(e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree")), "node", "full").na.fill(0)


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank after a fixed number of rounds; ranks sum to 1, dangling rank is spread evenly. Written out every few rounds."""
    e = materialize(edges.select("source", "target").distinct(), "edges")
    nodes = materialize(e.select(F.col("source").alias("node")).union(e.select("target")).distinct(), "nodes")
    n = nodes.count()
    out = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outs"))
    ranks = nodes.join(out, "node", "left").withColumn("rank", F.lit(1.0 / max(n, 1)))
    written = None
    for i in range(rounds):
        loose = ranks.where("outs is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        sent = e.join(ranks.select(F.col("node").alias("source"), (F.col("rank") / F.col("outs")).alias("part")), "source").groupBy(F.col("target").alias("node")).agg(F.sum("part").alias("got"))
        ranks = ranks.select("node", "outs", loose.alias("loose")).join(sent, "node", "left").select("node", "outs", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if i % 3 == 2 or i == rounds - 1:
            before, ranks = written, materialize(ranks, "ranks")
            release(before)
            written = ranks
    return ranks.select("node", "rank")


def triangles(edges: DataFrame) -> DataFrame:
    """node, degree, n_triangles, clustering of the undirected graph. Edges point from lower to higher degree, so no node opens more than
    about the root of twice the edges of pairs, however many neighbours it has."""
    e = undirected(edges)
    both = e.union(e.select("target", "source")).toDF("node", "other")
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    d = e.join(degree.select(F.col("node").alias("source"), F.col("degree").alias("ds")), "source").join(degree.select(F.col("node").alias("target"), F.col("degree").alias("dt")), "target")
    up = (F.col("ds") < F.col("dt")) | ((F.col("ds") == F.col("dt")) & (F.col("source") < F.col("target")))
    o = materialize(d.select(F.when(up, F.col("source")).otherwise(F.col("target")).alias("a"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("b")), "oriented")
    wedges = o.join(o.withColumnRenamed("b", "c"), "a").where("b < c").select("a", "b", "c")
    closed = wedges.join(e.select(F.col("source").alias("b"), F.col("target").alias("c")), ["b", "c"])
    per = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("n_triangles"))
    out = degree.join(per, "node", "left").na.fill(0)
    return out.withColumn("clustering", F.coalesce(F.try_divide(F.col("n_triangles") * 2.0, F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)))


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, transitivity, mean clustering, n_components."""
    t = materialize(triangles(edges), "triangles")
    c = components(edges).agg(F.countDistinct("component").alias("n_components"))
    pairs = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    out = t.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.try_divide(F.sum("n_triangles"), pairs).alias("transitivity"), F.avg("clustering").alias("mean_clustering"))
    return out.withColumn("n_components", c.scalar())


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node, component (its smallest member) of the directed graph: nodes that reach each other.

    Forward-backward colouring: the smallest node that reaches each node is spread along the edges, then its component is what reaches it back
    within the colour; settled nodes leave the graph. Rounds grow with the paths inside components."""
    left = materialize(edges.where("source <> target").select("source", "target").distinct(), "edges")
    nodes = materialize(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), "nodes")
    done: DataFrame | None = None
    for _ in range(max_rounds):
        colour = _spread(nodes.withColumn("label", F.col("node")), left, max_rounds)
        # Backwards from each colour's root, inside the colour.
        inside = left.join(colour.select(F.col("node").alias("source"), F.col("label").alias("ls")), "source").join(colour.select(F.col("node").alias("target"), F.col("label").alias("lt")), "target").where("ls = lt").select("source", "target")
        inside = materialize(inside, "inside")
        back = colour.withColumn("label", F.when(F.col("label") == F.col("node"), F.col("node")))
        reached = _spread(back, inside.select(F.col("target").alias("source"), F.col("source").alias("target")), max_rounds)
        settled = materialize(reached.where("label is not null").select("node", F.col("label").alias("component")), "settled")
        done = settled if done is None else done.unionByName(settled)
        before = (nodes, left, inside)
        nodes = materialize(nodes.join(settled, "node", "left_anti"), "nodes")
        if nodes.isEmpty():
            return done
        left = materialize(inside.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi"), "edges")
        release(*before)
    raise RuntimeError("strong components did not settle")


def _spread(labels: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """Smallest label that reaches each node along the edges."""
    labels = new = materialize(labels.select("node", "label"), "labels")
    for _ in range(max_rounds):
        came = edges.join(labels.select(F.col("node").alias("source"), "label"), "source").where("label is not null").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("came"))
        before = new
        new = materialize(labels.join(came, "node", "left").select("node", F.least("label", "came").alias("label"), (~F.least("label", "came").eqNullSafe(F.col("label"))).alias("moved")), "labels")
        release(before)
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, distance along directed edges from the given sources (column node), by breadth-first rounds until none is new; unreachable nodes are left out."""
    e = materialize(edges.select("source", "target").distinct(), "edges")
    seen = front = materialize(sources.select(F.col("node").alias("origin"), "node", F.lit(0).alias("distance")).distinct(), "seen")
    for step in count(1):
        out = front.select("origin", F.col("node").alias("source")).join(e, "source").select("origin", F.col("target").alias("node")).distinct()
        before = (seen, front)
        front = materialize(out.join(seen, ["origin", "node"], "left_anti").withColumn("distance", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "seen")
        release(*before)
    return seen.select(F.col("origin").alias("source"), "node", "distance")


def quotient(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups (node, group): each group named by its smallest node, loops dropped; nodes without a group stay themselves."""
    named = groups.groupBy("group").agg(F.min("node").alias("name"))
    of = groups.join(named, "group").groupBy("node").agg(F.min("name").alias("name"))
    out = edges.join(of.select(F.col("node").alias("source"), F.col("name").alias("s")), "source", "left").join(of.select(F.col("node").alias("target"), F.col("name").alias("t")), "target", "left")
    return out.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target")).where("source <> target").distinct()


def projected(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """User edges as edges between what the users (user_id) stand for (show_id): source, target, n."""
    s = owners.select(F.col("user_id").alias("source"), F.col("show_id").alias("s"))
    t = owners.select(F.col("user_id").alias("target"), F.col("show_id").alias("t"))
    return edges.join(s, "source").join(t, "target").groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count("*").alias("n"))


def dyads(nodes: DataFrame, graphs: dict[str, DataFrame]) -> DataFrame:
    """Every unordered pair of nodes with one flag a graph: whether an edge joins them, in either direction. For node sets of bounded size."""
    a, b = nodes.select(F.col("node").alias("a")), nodes.select(F.col("node").alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    for name, edges in graphs.items():
        pairs = pairs.join(undirected(edges).select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias(name)), ["a", "b"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return pairs


# -- communities -------------------------------------------------------------------------------------------------------

def louvain_of(edges: list[tuple[int, int, float]], resolution: float = 1.0) -> dict[int, int]:
    """Communities (named by their smallest node) of one weighted undirected graph: greedy modularity moves in node order, then
    aggregation, until nothing moves. Ties go to the smallest label, so the result depends on the graph alone."""
    graph: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        if a != b:
            graph[b][a] = graph[b].get(a, 0.0) + w
    belongs = {v: v for v in graph}
    total = sum(w for v in graph for w in graph[v].values())
    while total > 0:
        label = {v: v for v in graph}
        strength = {v: sum(graph[v].values()) + graph[v].get(v, 0.0) for v in graph}
        whole = sum(strength.values())
        weight = dict(strength)
        moved_any, moving = False, True
        while moving:
            moving = False
            for v in sorted(graph):
                around: dict[int, float] = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        around[label[u]] += w
                weight[label[v]] -= strength[v]
                gain = lambda c: around.get(c, 0.0) - resolution * strength[v] * weight[c] / whole  # noqa: B023, E731
                best = label[v]
                for c in sorted(around):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                weight[best] += strength[v]
                if best != label[v]:
                    label[v], moving, moved_any = best, True, True
        if not moved_any:
            break
        belongs = {v: label[c] for v, c in belongs.items()}
        merged: dict[int, dict[int, float]] = defaultdict(dict)
        for v in graph:
            for u, w in graph[v].items():
                a, b = label[v], label[u]
                if a == b:
                    # A loop holds the weight inside once; an edge is seen from both ends.
                    merged[a][a] = merged[a].get(a, 0.0) + (w if u == v else w / 2)
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        graph = merged
    names: dict[int, int] = {}
    for v in sorted(belongs):
        names.setdefault(belongs[v], v)
    return {v: names[c] for v, c in belongs.items()}


def communities(edges: DataFrame, labels: DataFrame, resolution: float = 1.0, most_edges: int = 5_000_000) -> DataFrame:
    """component, node, community: Louvain inside each component of (source, target, sim), each in one Arrow group.

    A component above `most_edges` edges does not fit one worker: its communities are found by moved_communities, by moves in parallel instead of one after the other."""
    e = materialize(edges.join(labels.select(F.col("node").alias("source"), "component"), "source").select("component", "source", "target", "sim"), "edges")
    # At most one component for each `most_edges` edges of the graph.
    large = sorted(r[0] for r in e.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("component").collect())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain_of(list(pdf[["source", "target", "sim"]].sort_values(["source", "target"]).itertuples(index=False, name=None)), resolution)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "node": list(found), "community": list(found.values())})

    found = e.where(~F.col("component").isin(large)).groupBy("component").applyInPandas(run, "component bigint, node bigint, community bigint")
    for c in large:
        found = found.unionByName(moved_communities(e.where(F.col("component") == c), resolution).select(F.lit(c).cast("bigint").alias("component"), "node", "community"))
    return found


def moved_communities(edges: DataFrame, resolution: float = 1.0, most_rounds: int = 40) -> DataFrame:
    """node, community (its smallest node) of a weighted undirected graph (source, target, sim; each edge once) of any size, by modularity moves on edge tables.

    In each round half of the nodes, chosen by a hash, go to the neighbouring community of greatest gain (the smallest of equal ones); rounds end when both halves stay, or at the first
    that does not raise the modularity, which is discarded. Communities then become nodes, until none moves. Nothing is held by one worker: gains are sums over edges by node and
    community. As nodes move in parallel, communities may differ from those of `louvain_of`; their modularity is tested to come near."""
    e = edges.where("source is not null and target is not null").select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("sim").cast("double").alias("w"))
    belongs: DataFrame | None = None
    while True:
        both = materialize(e.where("a <> b").union(e.where("a <> b").select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "both")
        loops = e.where("a = b").groupBy("a").agg((2 * F.sum("w")).alias("w"))
        nodes = materialize(both.select("a", "w").union(loops).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "nodes")
        whole = nodes.agg(F.sum("k")).first()[0] or 0.0
        if whole <= 0:
            return nodes.select("node", F.col("node").alias("community"))
        inside = e.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

        def looked(labels: DataFrame) -> DataFrame:
            """Each node with its community c, the weight `within` to it, the gain of staying and the best move: one pass over the edges, that of the modularity too."""
            own = labels.join(nodes, "node")  # noqa: B023
            totals = own.groupBy("c").agg(F.sum("k").alias("t"))
            near = both.join(labels.select(F.col("node").alias("b"), "c"), "b").select("a", "c", "w").union(labels.select(F.col("node").alias("a"), "c", F.lit(0.0)))  # noqa: B023
            near = near.groupBy("a", "c").agg(F.sum("w").alias("w")).join(totals, "c").join(own.select(F.col("node").alias("a"), F.col("c").alias("now"), "k"), "a")
            gain = F.round((F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) / whole) / whole, 15)  # noqa: B023
            stays = lambda x: F.max(F.when(F.col("c") == F.col("now"), F.col(x)))
            best = near.withColumn("gain", gain).groupBy(F.col("a").alias("node")).agg(F.max("now").alias("now"), F.max("k").alias("k"), F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("best"), stays("gain").alias("stay"), stays("w").alias("within"))
            return materialize(best.select("node", F.col("now").alias("c"), "k", "within", "stay", F.col("best.gain").alias("gain"), (-F.col("best.c")).alias("to")), "look")

        def quality(look: DataFrame) -> float:
            found = look.groupBy("c").agg(F.sum("within").alias("within"), F.sum("k").alias("t")).agg(F.sum("within"), F.sum(F.col("t") * F.col("t"))).first()
            return (found[0] + 2 * inside) / whole - resolution * found[1] / whole / whole  # noqa: B023

        look = looked(nodes.select("node", F.col("node").alias("c")))
        reached, still, moved_any = quality(look), 0, False
        for turn in range(most_rounds):
            moves = (F.col("gain") > F.col("stay")) & (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2)
            if look.where(moves).isEmpty():
                still += 1
                if still == 2:
                    break
                continue
            ahead = looked(look.select("node", F.when(moves, F.col("to")).otherwise(F.col("c")).alias("c")))
            better = quality(ahead)
            if better <= reached + 1e-12:
                release(ahead)
                break
            release(look)
            look, reached, still, moved_any = ahead, better, 0, True
        labels = look.select("node", "c")
        named = materialize(labels.join(labels.groupBy("c").agg(F.min("node").alias("name")), "c").select("node", F.col("name").alias("community")), "named")
        belongs = named if belongs is None else materialize(belongs.select("node", F.col("community").alias("was")).join(named.withColumnRenamed("node", "was"), "was").select("node", "community"), "belongs")
        if not moved_any:
            names = belongs.groupBy("community").agg(F.min("node").alias("name"))
            return belongs.join(names, "community").select("node", F.col("name").alias("community"))
        ends = e.join(named.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
        # Seen from both ends, an edge inside a community is its loop once.
        e = materialize(ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")


def modularity(edges: DataFrame, labels: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: modularity and coverage (share of weight inside communities) of a partition (node, community)."""
    e = edges.select("source", "target", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    e = e.join(labels.select(F.col("node").alias("source"), F.col("community").alias("cs")), "source").join(labels.select(F.col("node").alias("target"), F.col("community").alias("ct")), "target")
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "w"), F.struct(F.col("ct").alias("c"), "w"))).alias("x")).groupBy("x.c").agg(F.sum("x.w").alias("k"))
    total = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0)).alias("inside"))
    return ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk")).join(total, F.lit(True)).select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"), (F.col("inside") / F.col("m")).alias("coverage"))


def agreed_communities(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """group, community for the groups (node, group) whose members all fall into one community."""
    found = groups.join(labels, "node").groupBy("group").agg(F.min("community").alias("community"), F.max("community").alias("other"))
    return found.where("community = other").drop("other")


# -- centrality --------------------------------------------------------------------------------------------------------

def betweenness(edges: DataFrame, most_edges: int = 2_000_000, origin_rows: int = 200_000_000) -> DataFrame:
    """node, betweenness of the undirected unweighted graph: one shortest-path pass for each source node. Up to `most_edges` edges every worker holds the
    adjacency and takes a part of the sources; a larger graph is walked by joins of edge tables (see _joined_betweenness), to the same result."""
    spark = edges.sparkSession
    e = materialize(undirected(edges), "edges")
    if e.count() > most_edges:
        return _joined_betweenness(e, origin_rows)
    adjacency: dict[int, list[int]] = defaultdict(list)
    for r in e.collect():
        adjacency[r[0]].append(r[1])
        adjacency[r[1]].append(r[0])
    sent = spark.sparkContext.broadcast({k: sorted(v) for k, v in adjacency.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, score = sent.value, defaultdict(float)
        for batch in batches:
            for s in batch["node"].tolist():
                order, before, paths, far = [], defaultdict(list), defaultdict(float), {s: 0}
                paths[s] = 1.0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for u in graph[v]:
                        if u not in far:
                            far[u] = far[v] + 1
                            queue.append(u)
                        if far[u] == far[v] + 1:
                            paths[u] += paths[v]
                            before[u].append(v)
                share = defaultdict(float)
                for v in reversed(order):
                    for u in before[v]:
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != s:
                        score[v] += share[v]
        yield pd.DataFrame({"node": list(score), "b": list(score.values())})

    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    parts = nodes.repartition(spark.sparkContext.defaultParallelism, "node").mapInPandas(run, "node bigint, b double")
    return nodes.join(parts.groupBy("node").agg((F.sum("b") / 2).alias("betweenness")), "node", "left").na.fill(0.0)


def _joined_betweenness(e: DataFrame, origin_rows: int) -> DataFrame:
    """Betweenness by joins: all sources of a block walk out level by level with their numbers of shortest paths, then the shares of the paths are summed on the way back.

    The work is that of the exact measure, sources times edges; blocks of sources bound the rows of a walk to about `origin_rows`."""
    both = materialize(e.select(F.col("source").alias("node"), F.col("target").alias("other")).union(e.select("target", "source")), "both")
    nodes = materialize(both.select("node").distinct(), "nodes")
    n = nodes.count()
    blocks = max(1, -(-n * n // origin_rows))
    scores: list[DataFrame] = []
    for block in range(blocks):
        mine = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        levels = [materialize(mine.select(F.col("node").alias("origin"), "node", F.lit(1.0).alias("paths")), "level")]
        while True:
            reached = levels[-1].join(both, "node").groupBy("origin", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
            # Two levels back are all that a neighbour of the last level can lie in.
            for before in levels[-2:]:
                reached = reached.join(before.select("origin", "node"), ["origin", "node"], "left_anti")
            level = materialize(reached, "level")
            if level.isEmpty():
                break
            levels.append(level)
        share = levels[-1].select("origin", "node", "paths", F.lit(0.0).alias("share"))
        shares = [share]
        for before in levels[-2::-1]:
            sent = share.join(both, "node").select("origin", F.col("other").alias("node"), ((1 + F.col("share")) / F.col("paths")).alias("part")).groupBy("origin", "node").agg(F.sum("part").alias("part"))
            share = materialize(before.join(sent, ["origin", "node"], "left").select("origin", "node", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")), "share")
            shares.append(share)
        # A source's own share, on level 0, is not between anything.
        block_score = shares[0].select("node", "share")
        for s in shares[1:-1]:
            block_score = block_score.unionByName(s.select("node", "share"))
        scores.append(materialize(block_score.groupBy("node").agg(F.sum("share").alias("b")), "score"))
        release(*levels, *shares)
    every = nodes.select("node", F.lit(0.0).alias("b"))
    for s in scores:
        every = every.unionByName(s)
    return every.groupBy("node").agg((F.sum("b") / 2).alias("betweenness"))


def simrank(edges: DataFrame, rounds: int = 5, decay: float = 0.9, least: float = 0.0) -> DataFrame:
    """a < b, score: how alike two nodes are by their in-neighbours, iterated. All positive scores stay; a `least` above 0 drops
    lower scores in every round, and what they would pass on with them.
    Pairs are opened only where two nodes share a scored pair of in-neighbours."""
    e = materialize(edges.select("source", "target").distinct(), "edges")
    ins = e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    nodes = e.select(F.col("source").alias("x")).union(e.select("target")).distinct()
    scores = nodes.select(F.col("x").alias("u"), F.col("x").alias("v"), F.lit(1.0).alias("s"))
    for _ in range(rounds):
        opened = scores.join(e.select(F.col("source").alias("u"), F.col("target").alias("a")), "u").join(e.select(F.col("source").alias("v"), F.col("target").alias("b")), "v").where("a <> b")
        sums = opened.groupBy("a", "b").agg(F.sum("s").alias("s"))
        new = sums.join(ins.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(ins.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), (decay * F.col("s") / (F.col("na") * F.col("nb"))).alias("s")).where(F.col("s") >= least)
        before = scores
        scores = materialize(new.unionByName(nodes.select(F.col("x").alias("u"), F.col("x").alias("v"), F.lit(1.0).alias("s"))), "scores")
        release(before)
    return scores.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("s").alias("score"))


def follow_graph(follows: DataFrame, tagged: DataFrame) -> DataFrame:
    """Edges among tagged users (user_id) in the latest fetch of each source: source, target. follows: source, target, fetched."""
    last = follows.groupBy("source").agg(F.max("fetched").alias("fetched"))
    now = follows.join(last, ["source", "fetched"])
    inside = now.join(tagged.select(F.col("user_id").alias("source")), "source", "left_semi").join(tagged.select(F.col("user_id").alias("target")), "target", "left_semi")
    return inside.select("source", "target").distinct()


def followers_of_several(follows: DataFrame, tagged: DataFrame, least: int = 2) -> DataFrame:
    """Edges to tagged users from sources that follow at least `least` of them."""
    to = follows.join(tagged.select(F.col("user_id").alias("target")), "target", "left_semi").select("source", "target").distinct()
    return to.join(to.groupBy("source").count().where(F.col("count") >= least).select("source"), "source", "left_semi")


def friends_of_followers(follows: DataFrame, tagged: DataFrame) -> DataFrame:
    """How many followers of tagged users follow each other account: target, n_followers."""
    followers = follows.join(tagged.select(F.col("user_id").alias("target")), "target", "left_semi").select("source").distinct()
    return follows.join(followers, "source", "left_semi").groupBy("target").agg(F.countDistinct("source").alias("n_followers"))


def interactions(posts: DataFrame, time: str, source: str, target: str) -> DataFrame:
    """Monthly edges between authors and those they mention, answer or repost: source, target, year, month, n."""
    return posts.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source"), F.col(target).alias("target"), F.year(time).alias("year"), F.month(time).alias("month")).agg(F.count("*").alias("n"))
