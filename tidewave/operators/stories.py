"""Stories: groups of similar items, merged, filtered by news, matched across kinds, and described."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import graphs, ticks, vectors
from tidewave.operators.joins import overlapping
from tidewave.operators.stats import exact_quantiles
from tidewave.operators.windows import with_group
from tidewave.storage import materialize, release


def numbered(members: DataFrame, kind: list[str]) -> DataFrame:
    """Community numbers within each kind: components by size (largest first), then community: adds group_no from 0."""
    sizes = members.groupBy(*kind, "component").agg(F.countDistinct("node").alias("__size"))
    w = Window.partitionBy(*kind).orderBy(F.col("__size").desc(), "component", "community")
    groups = members.select(*kind, "component", "community").distinct().join(sizes, [*kind, "component"])
    return members.join(groups.withColumn("group_no", F.dense_rank().over(w) - 1).drop("__size"), [*kind, "component", "community"])


def tightened(edges: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Edges that also reach a stricter threshold of their group."""
    return edges.join(thresholds.select(*by, "threshold"), by).where("sim >= threshold").drop("threshold")


def story_vectors(items: DataFrame, by: list[str], story: str, time: str, vec: str) -> DataFrame:
    """Per story: mean vector, n, start1 and end1 (first and last time), dur."""
    spans = items.groupBy(*by, story).agg(F.min(time).alias("start1"), F.max(time).alias("end1"))
    return vectors.mean_vectors(items, [*by, story], vec).join(spans, [*by, story]).withColumn("dur", F.col("end1") - F.col("start1"))


def merged(stories: DataFrame, by: list[str], story: str, vec: str, quantile: float = 0.9999, rows_a_tile: int = 2000) -> DataFrame:
    """Stories of one kind that do not overlap in time and are more alike than the `quantile` of all such pairs become one:
    by, story, merged_into (the greatest member; itself for the rest).

    All allowed pairs count for the quantile, so each group's stories are compared in tiles of at most `rows_a_tile` rows a side, by matrix
    products; a first pass builds a histogram of similarities (20,000 bins a group), a second keeps the pairs above the bin of the
    quantile, and the exact value is taken among the pairs of that bin."""
    n_bins = 20000
    names = [*by]
    s = stories.select(*by, F.col(story).alias("sid"), "start1", "end1", F.col(vec).alias("v"))
    tiles = s.groupBy(*by).agg(F.ceil(F.count("*") / rows_a_tile).cast("int").alias("tiles"))
    s = s.join(tiles, by).withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = s.withColumn("other", F.explode(every)).select(*by, F.col("tile").alias("ti"), F.col("other").alias("tj"), "sid", "start1", "end1", "v", F.lit(0).alias("side"))
    right = s.withColumn("other", F.explode(every)).select(*by, F.col("other").alias("ti"), F.col("tile").alias("tj"), "sid", "start1", "end1", "v", F.lit(1).alias("side"))
    work = left.unionByName(right)

    def tile(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, pd.DataFrame]:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        x, y = np.array(a["v"].tolist(), float), np.array(b["v"].tolist(), float)
        if not len(a) or not len(b):
            return np.empty((0, 0)), a, b
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        sim = x @ y.T
        apart = ~((b["start1"].to_numpy()[None, :] < a["end1"].to_numpy()[:, None]) & (b["end1"].to_numpy()[None, :] > a["start1"].to_numpy()[:, None]))
        allowed = apart & (a["sid"].to_numpy()[:, None] < b["sid"].to_numpy()[None, :])
        return np.where(allowed, sim, np.nan), a, b

    kinds = dict(stories.dtypes)
    head = ", ".join(f"{b} {kinds[b]}" for b in by)

    def histogram(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sim = tile(pdf)[0]
        sim = sim[~np.isnan(sim)]
        bins, n = np.unique(np.clip(((sim + 1) / 2 * n_bins).astype(int), 0, n_bins - 1), return_counts=True)
        return pd.DataFrame([(*key[: len(by)], int(b), int(c)) for b, c in zip(bins, n)], columns=[*names, "bin", "n"])

    counts = work.groupBy(*by, "ti", "tj").applyInPandas(histogram, f"{head}, bin int, n bigint").groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")
    cum = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by))).withColumn("at", F.lit(quantile) * (F.col("all") - 1))
    # The quantile lies between the sorted values floor(at) and floor(at) + 1.
    low = cum.where(F.col("upto") > F.floor("at")).groupBy(*by).agg(F.min(F.struct("bin", "n", "upto", "at")).alias("q")).select(*by, F.col("q.bin").alias("bin"), (F.col("q.upto") - F.col("q.n")).alias("below"), F.col("q.at").alias("at"))

    def close(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sim, a, b = tile(pdf)
        limit = pdf["bin"].iloc[0] / n_bins * 2 - 1
        out = [(*key[: len(by)], int(a["sid"].iloc[i]), int(b["sid"].iloc[j]), float(sim[i, j])) for i, j in zip(*np.nonzero(sim >= limit - 1e-12))] if sim.size else []
        return pd.DataFrame(out, columns=[*names, "source", "target", "sim"])

    top = work.join(low.select(*by, "bin"), by).groupBy(*by, "ti", "tj").applyInPandas(close, f"{head}, source bigint, target bigint, sim double")

    top = materialize(top, "close")
    ranked = top.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("sim")) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*by)))
    total = cum.groupBy(*by).agg(F.max("upto").alias("all"), F.max("at").alias("at"))
    ranked = ranked.join(total, by).withColumn("no", F.col("no") + F.col("all") - F.col("m"))
    cut = ranked.groupBy(*by).agg(F.max(F.when(F.col("no") == F.floor("at"), F.col("sim"))).alias("a"), F.max(F.when(F.col("no") == F.floor("at") + 1, F.col("sim"))).alias("b"), F.max("at").alias("at"))
    cut = cut.select(*by, (F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("limit"))
    edges = top.join(cut, by).where("sim > limit").select("source", "target")
    labels = graphs.components(edges)
    best = labels.groupBy("component").agg(F.max("node").alias("merged_into"))
    return stories.join(labels.join(best, "component").select(F.col("node").alias(story), "merged_into"), story, "left").select(*by, story, F.coalesce("merged_into", story).alias("merged_into"))


def similar_overlapping(stories: DataFrame, by: list[str], story: str, vec: str, width: float) -> DataFrame:
    """Pairs of stories of different kinds that overlap in time, with cosine, count_ratio and dur_ratio (larger by smaller, null at 0): id1 < id2."""
    side = lambda i: stories.select(*by, F.col(story).alias(f"id{i}"), F.col("kind").alias(f"kind{i}"), F.col("start1").alias(f"start{i}"), F.col("end1").alias(f"end{i}"), F.col("n").alias(f"n{i}"), F.col("dur").alias(f"dur{i}"), F.col(vec).alias(f"v{i}"))
    pairs = overlapping(side(1), side(2), by, width, (F.col("id1") < F.col("id2")) & (F.col("kind1") != F.col("kind2")))
    ratio = lambda c: F.try_divide(F.greatest(f"{c}1", f"{c}2").cast("double"), F.least(f"{c}1", f"{c}2").cast("double"))
    return pairs.select(*by, "id1", "id2", "kind1", "kind2", vectors.cosine(F.col("v1"), F.col("v2")).alias("sim"), ratio("n").alias("count_ratio"), ratio("dur").alias("dur_ratio"), "n1", "n2")


def news(stories: DataFrame, pairs: DataFrame, story: str, reference: str = "elite", least: float = 0.6) -> DataFrame:
    """Stories of the reference kind, and of others those like one of them at the same time."""
    hit = pairs.where(((F.col("kind1") == reference) | (F.col("kind2") == reference)) & (F.col("sim") >= least))
    kept = hit.select(F.when(F.col("kind1") == reference, F.col("id2")).otherwise(F.col("id1")).alias(story)).distinct()
    return stories.where(F.col("kind") == reference).unionByName(stories.where(F.col("kind") != reference).join(kept, story, "left_semi"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of greatest total weight; entries of 0 or less are never paired. Shortest augmenting paths."""
    n, m = weights.shape
    if n > m:
        return [(j, i) for i, j in assignment(weights.T)]
    cost = np.zeros((n, m + n))
    cost[:, :m] = -np.maximum(weights, 0)
    u, v = np.zeros(n + 1), np.zeros(m + n + 1)
    owner = np.zeros(m + n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, int), np.zeros(m + n + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j] and weights[owner[j] - 1, j - 1] > 0)


def best_matching(pairs: DataFrame, most_nodes: int = 5000) -> DataFrame:
    """The matching of greatest total weight of a bipartite graph (left, right, weight): left, right, weight. Nodes may stay single.

    Components are independent and solved one a group; a component above `most_nodes` nodes on its larger side raises an error: auction_matching has no such limit."""
    ids = pairs.select((F.col("left") * 2).alias("source"), (F.col("right") * 2 + 1).alias("target"), "left", "right", "weight").where("weight > 0")
    labels = graphs.components(ids.select("source", "target"))
    grouped = ids.join(labels.select(F.col("node").alias("source"), "component"), "source")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ls, rs = sorted(pdf["left"].unique()), sorted(pdf["right"].unique())
        if max(len(ls), len(rs)) > most_nodes:
            raise ValueError(f"component of {len(ls)} x {len(rs)} nodes")
        li, ri = {x: i for i, x in enumerate(ls)}, {x: i for i, x in enumerate(rs)}
        w = np.zeros((len(ls), len(rs)))
        for a, b, x in pdf[["left", "right", "weight"]].itertuples(index=False):
            w[li[a], ri[b]] = max(w[li[a], ri[b]], x)
        found = assignment(w)
        return pd.DataFrame({"left": [ls[i] for i, _ in found], "right": [rs[j] for _, j in found], "weight": [float(w[i, j]) for i, j in found]})

    return grouped.select("component", "left", "right", "weight").groupBy("component").applyInPandas(solve, "left bigint, right bigint, weight double")


def auction_matching(pairs: DataFrame, slack: float = 1e-3) -> DataFrame:
    """A matching of a bipartite graph (left, right, weight) of any size, by an auction on tables: left, right, weight. Its total is at most `slack` below the greatest for each matched
    left node; weights that are multiples of d give the greatest itself with a `slack` below d / nodes.

    In every round each left node without a partner bids for its best right node at the going prices, up to what its second best (or staying single) leaves; each right node goes to the
    highest bid, whose price rises by `slack` at least. Nodes that no price leaves a gain stay single. Ties go to smaller ids. Weights of 0 or less and nulls are never paired; repeated pairs count by their greatest weight."""
    w = materialize(pairs.where("weight > 0 and left is not null and right is not null").groupBy("left", "right").agg(F.max("weight").cast("double").alias("weight")), "pairs")
    spark = w.sparkSession
    held = spark.createDataFrame([], f"right {dict(w.dtypes)['right']}, price double, left {dict(w.dtypes)['left']}")
    waiting = materialize(w.select("left").distinct(), "waiting")
    while not waiting.isEmpty():
        value = F.col("weight") - F.coalesce("price", F.lit(0.0))
        offers = materialize(w.join(waiting, "left").join(held.select("right", "price"), "right", "left").select("left", "right", F.coalesce("price", F.lit(0.0)).alias("price"), value.alias("value")), "offers")
        best = offers.groupBy("left").agg(F.max(F.struct("value", (-F.col("right")).alias("r"), "price")).alias("b")).where("b.value > 0")
        second = offers.join(best.select("left", (-F.col("b.r")).alias("first")), "left").where("right <> first").groupBy("left").agg(F.max("value").alias("second"))
        bids = best.join(second, "left", "left").select("left", (-F.col("b.r")).alias("right"), (F.col("b.price") + F.col("b.value") - F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0)) + slack).alias("price"))
        bids = materialize(bids, "bids")
        won = bids.groupBy("right").agg(F.max(F.struct("price", (-F.col("left")).alias("l"))).alias("b")).select("right", F.col("b.price").alias("price"), (-F.col("b.l")).alias("left"))
        won = materialize(won, "won")
        lost = bids.select("left").join(won.select("left"), "left", "left_anti").union(held.join(won.select("right"), "right", "left_semi").select("left"))
        before = (held, waiting, offers)
        new = materialize(held.join(won.select("right"), "right", "left_anti").unionByName(won), "held")
        waiting = materialize(lost, "waiting")
        release(*before, bids, won)
        held = new
    return held.join(w, ["left", "right"]).select("left", "right", "weight")


def story_stats(items: DataFrame, story: str, time: str, side: Column, text: str, topic: Column) -> DataFrame:
    """Per story and side ('all' and each value of `side`): count, start, end, dur, mean, sd, iqr of the time since the side's first item, mean
    time since the story's first (avg_abs), share of items on the topic, mean and deviation of words and characters.

    Every story has a row for every side; empty sides have nulls."""
    rows = with_group(items.withColumn("side", F.explode(F.array(F.lit("all"), side))).where("side is not null"), [story], __first=F.min(time))
    rows = with_group(rows.withColumn("abs", F.col(time) - F.col("__first")), [story, "side"], __own=F.min(time)).withColumn("rel", F.col(time) - F.col("__own")).withColumn("words", F.size(F.filter(F.split(F.trim(F.replace(F.col(text), F.lit("_"), F.lit(""))), r"\s+"), lambda w: w != ""))).withColumn("chars", F.length(text))
    stats = rows.groupBy(story, "side").agg(
        F.count("*").alias("count"), F.min(time).alias("start"), F.max(time).alias("end"), (F.max(time) - F.min(time)).alias("dur"), F.avg("rel").alias("avg"), F.stddev_samp("rel").alias("std"),
        F.avg("abs").alias("avg_abs"), F.avg(topic.cast("int")).alias("topic_share"),
        F.avg("words").alias("word_mean"), F.stddev_samp("words").alias("word_sd"), F.avg("chars").alias("char_mean"), F.stddev_samp("chars").alias("char_sd"),
    )
    quarters = exact_quantiles(rows, [story, "side"], "rel", [0.25, 0.75]).select(story, "side", (F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))).alias("iqr"))
    stats = stats.join(quarters, [story, "side"], "left")
    frame = rows.select(story).distinct().join(rows.select("side").distinct(), F.lit(True))
    return frame.join(stats, [story, "side"], "left")


def story_curves(items: DataFrame, story: str, side: str, time: str, step: float = 60.0, points: int = 10080) -> DataFrame:
    """Cumulative distributions of each story and side, from the side's own first item."""
    rel = with_group(items, [story, side], __own=F.min(time)).withColumn("rel", F.col(time) - F.col("__own"))
    return ticks.ecdf(rel, [story, side], "rel", step, points)


def probe_similarity(stories: DataFrame, vec: str, probe: list[float]) -> DataFrame:
    """How much each story resembles a given topic vector."""
    return stories.withColumn("probe_sim", vectors.cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in probe])))


def merge_report(merged_stories: DataFrame, by: list[str]) -> DataFrame:
    """Per group: stories before and after merging, stories merged away, and the largest number that became one."""
    sizes = merged_stories.groupBy(*by, "merged_into").agg(F.count("*").alias("c"))
    return sizes.groupBy(*by).agg(F.sum("c").alias("n_before"), F.count("*").alias("n_after"), (F.sum("c") - F.count("*")).alias("n_merged"), F.max("c").alias("largest"))


def ideology(items: DataFrame, communities: DataFrame, conservative: int) -> DataFrame:
    """side: 'conservative' or 'liberal': radio by whether its station is public, others by their author's community (unknown: liberal)."""
    known = communities.select("user_id", "community")
    side = F.when(F.col("kind") == "radio", ~F.col("is_public")).otherwise(F.coalesce(F.col("community") == conservative, F.lit(False)))
    return items.join(known, "user_id", "left").withColumn("side", F.when(side, "conservative").otherwise("liberal")).drop("community")


def example(items: DataFrame, story: str, members: list, time: str, key: str, n: int = 10, step: float = 60.0, points: int = 2880) -> tuple[DataFrame, DataFrame]:
    """A look at one story (or several read as one): its first `n` items and as many by a fixed hash of their key, with `which` ('first' or 'sample') and `reltime`, the time since
    its first item; and the curve of its items in time: point, value (share of items so far), density (its gradient)."""
    from tidewave.operators.windows import gradient, hash_order

    mine = items.where(F.col(story).isin(members))
    mine = mine.withColumn("reltime", F.col(time) - mine.agg(F.min(time)).scalar())
    shown = mine.orderBy("reltime", key).limit(n).withColumn("which", F.lit("first")).unionByName(mine.orderBy(hash_order(F.col(key)), key).limit(n).withColumn("which", F.lit("sample")))
    curve = ticks.ecdf(mine.withColumn("__all", F.lit(0)), ["__all"], "reltime", step, points)
    return shown, gradient(curve, ["__all"], "point", "value", "density").drop("__all")
