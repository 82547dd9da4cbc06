"""Dense vectors: similarities, nearest rows, blocked similarity joins, sentence vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.windows import hash_order
from tidewave.storage import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if one of them is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(df: DataFrame, vec: str, zeros: str = "ignore") -> DataFrame:
    """Rows scaled to length 1. Zero rows: 'ignore' leaves null entries, 'drop' drops the row, 'raise' fails."""
    out = df.withColumn("__n", norm(F.col(vec)))
    if zeros == "drop":
        out = out.where("__n > 0")
    elif zeros == "raise":
        out = out.withColumn("__n", F.when(F.col("__n") > 0, F.col("__n")).otherwise(F.raise_error(F.lit("a row has length zero"))))
    return out.withColumn(vec, F.transform(vec, lambda x: F.try_divide(x.cast("double"), F.col("__n")))).drop("__n")


def mean_vectors(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """The mean vector of each group and its size: entries averaged by position, pre-aggregated before the shuffle."""
    entries = df.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return entries.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e.m).alias(vec), F.max("n").alias("n"))


def top_k(corpus: DataFrame, queries: DataFrame, id_col: str, vec: str, k: int, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """The k nearest corpus rows of each query row (not itself): query_id, id, score, rank; best first, ties by id.

    Queries go out in blocks of at most `block` rows, one scan of the corpus for each; every corpus partition keeps its own k best of a query
    (Arrow batches and one matrix product each) before anything is shuffled."""
    spark = corpus.sparkSession
    parts = []
    rows: list = []

    def scan(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = sent.value
            qn = np.linalg.norm(q, axis=1)
            best: dict[int, list] = {}
            for b in batches:
                if not len(b):
                    continue
                x, ids = np.array(b["v"].tolist(), dtype=np.float64), b["i"].to_numpy()
                if metric == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = (q @ x.T) / qn[:, None] / np.linalg.norm(x, axis=1)[None, :]
                    s = np.nan_to_num(s, nan=-2.0)
                else:
                    s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))
                for j in range(len(qid)):
                    row = np.where(ids == qid[j], -np.inf, s[j])
                    kth = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    some = np.flatnonzero((row >= kth) & np.isfinite(row))
                    mine = best.setdefault(j, [])
                    mine += [(-row[c], int(ids[c])) for c in some]
                    if len(mine) > 4 * k + 64:
                        best[j] = sorted(mine)[:k]
            out = [(int(qid[j]), i, -s) for j, mine in best.items() for s, i in sorted(mine)[:k]]
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

        return corpus.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec).alias("v")).mapInPandas(run, "query_id bigint, id bigint, score double")

    for r in queries.select(F.col(id_col).cast("bigint"), vec).toLocalIterator():
        rows.append((r[0], list(r[1])))
        if len(rows) == block:
            parts.append(scan(rows))
            rows = []
    if rows or not parts:
        parts.append(scan(rows or [(-1, [0.0])]))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc() if metric == "cosine" else F.round(-F.col("score"), 12), "id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("score", F.col("score") if metric == "cosine" else -F.col("score"))


def similarity_edges(items: DataFrame, by: list[str], id_col: str, time: str, vec: str, thresholds: DataFrame, window: float = 4000.0, span: int = 4, cell_rows: int = 4000) -> DataFrame:
    """Pairs of items of one group, close in time, whose dot product reaches the group's threshold: by, source < target (in order of time, id), sim.

    Two items are close if they lie in one window of `span` * `window` that starts at a multiple of `window`. Items go to the block of their own
    start and, as partners, to the blocks before that can share a window with it; a block with more than
    `cell_rows` items on a side has that side cut into tiles and the tiles paired, each block by its own size, so every matrix product is bounded, and each pair is made once, in the block of its earlier item."""
    items = items.select(*by, id_col, time, vec, F.floor(F.col(time) / window).cast("bigint").alias("block"))
    # A partner `span` blocks later counts only if it lies exactly on the window's closing edge.
    back = F.filter(F.sequence(F.lit(0), F.lit(span)), lambda i: (i < span) | (F.col(time) == F.col("block") * window))
    own = items.groupBy(*by, "block").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("tiles"))
    partners = items.select(*by, F.explode(F.transform(back, lambda i: F.col("block") - i)).alias("block")).groupBy(*by, "block").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
    sizes = materialize(own.join(partners, [*by, "block"]), "blocks")  # a row a block
    cut = lambda n: F.pmod(hash_order(F.col(id_col)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = items.join(sizes, [*by, "block"]).select(*by, "block", cut("tiles").alias("tile"), each("parts").alias("part"), id_col, time, vec, F.lit(0).alias("side"))
    second = items.withColumn("block", F.explode(F.transform(back, lambda i: F.col("block") - i))).join(sizes, [*by, "block"])
    second = second.select(*by, "block", each("tiles").alias("tile"), cut("parts").alias("part"), id_col, time, vec, F.lit(1).alias("side"))
    work = first.unionByName(second)
    limits = thresholds.select(*by, "threshold")
    schema = ", ".join([f"{b} {dict(items.dtypes)[b]}" for b in by] + ["source bigint", "target bigint", "sim double"])
    names = [*by, "block", "tile", "part"]

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(a) and len(b):
            x = np.array(a[vec].tolist(), dtype=np.float64)
            ta, ia = a[time].to_numpy(), a[id_col].to_numpy()
            limit = float(pdf["threshold"].iloc[0])
            for start in range(0, len(b), 4096):
                c = b.iloc[start : start + 4096]
                tb, ib = c[time].to_numpy(), c[id_col].to_numpy()
                sims = x @ np.array(c[vec].tolist(), dtype=np.float64).T
                later = (tb[None, :] > ta[:, None]) | ((tb[None, :] == ta[:, None]) & (ib[None, :] > ia[:, None]))
                for i, j in zip(*np.nonzero(later & (sims >= limit))):
                    out.append((*key[: len(by)], int(ia[i]), int(ib[j]), float(sims[i, j])))
        return pd.DataFrame(out, columns=[*by, "source", "target", "sim"])

    return work.join(limits, by).groupBy(*names).applyInPandas(pairs, schema)


def thresholds(items: DataFrame, by: list[str], id_col: str, time: str, vec: str, k: float, window: float = 4000.0, sample: int = 100) -> DataFrame:
    """Per group the mean and deviation of the dot products of a fixed sample of pairs from each time block: mean, sd, threshold = mean + k sd.

    From each block up to `sample` rows in two hash orders are paired, so the work grows with the number of blocks only."""
    from tidewave.operators.windows import top_per_group

    items = items.withColumn("__b", F.floor(F.col(time) / window))
    one = top_per_group(items, [*by, "__b"], [hash_order(F.col(id_col), 1), F.col(id_col)], sample).select(*by, "__b", F.col(vec).alias("v1"))
    two = top_per_group(items, [*by, "__b"], [hash_order(F.col(id_col), 2), F.col(id_col)], sample).select(*by, "__b", F.col(vec).alias("v2"))
    sims = one.join(two, [*by, "__b"]).select(*by, dot(F.col("v1"), F.col("v2")).alias("sim"))
    out = sims.groupBy(*by).agg(F.avg("sim").alias("mean"), F.stddev_samp("sim").alias("sd"))
    return out.withColumn("threshold", F.col("mean") + k * F.col("sd"))


def sentence_vectors(tokens: DataFrame, by: str, token: str, vectors: DataFrame, a: float = 1e-3) -> DataFrame:
    """Smooth inverse frequency means of word vectors, less their projection on the first singular vector.

    tokens: one row a word; vectors: token, vector. The d x d Gram matrix is the only thing the driver sees."""
    counts = tokens.groupBy(token).agg(F.count("*").alias("__c"))
    total = tokens.agg(F.count("*").cast("double")).scalar()
    weights = counts.withColumn("__w", F.lit(a) / (F.lit(a) + F.col("__c") / total)).select(token, "__w")
    rows = tokens.join(weights, token).join(vectors.select(F.col("token").alias(token), "vector"), token)
    scaled = rows.select(by, F.transform("vector", lambda x: x.cast("double")).alias("vector"), "__w").select(by, F.transform("vector", lambda x: x * F.col("__w")).alias("vector"))
    means = mean_vectors(scaled, [by], "vector")
    gram = means.select(F.posexplode("vector").alias("i", "x"), "vector").select("i", "x", F.posexplode("vector").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()
    if not gram:
        return means
    d = max(r.i for r in gram) + 1
    g = np.zeros((d, d))
    for r in gram:
        g[r.i, r.j] = r.g
    top = np.linalg.eigh(g)[1][:, -1]
    axis = F.array(*[F.lit(float(x)) for x in top])
    return means.withColumn("__p", dot(F.col("vector"), axis)).withColumn("vector", F.zip_with("vector", axis, lambda x, s: x - F.col("__p") * s)).drop("__p")
