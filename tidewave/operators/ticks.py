"""Events in time buckets, cumulative distributions, weighted moments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.stats import exact_quantiles


def matched(df: DataFrame, events: dict[str, Column]) -> DataFrame:
    """One integer column a named event."""
    return df.withColumns({k: v.cast("int") for k, v in events.items()})


def ticks(df: DataFrame, time: str, values: list[str], widths: list[str], by: list[str]) -> DataFrame:
    """Sums of `values` and numbers of rows in tumbling buckets of each width: over all rows with empty buckets filled in, and for each
    value of each column in `by` where it occurs (the other columns of `by` null). Null dimension values are left out.

    Columns: width, bucket, *by, n, *values. Each width is one pass over the rows with grouping sets, pre-aggregated."""
    out = []
    for width in widths:
        seconds = _seconds(width)
        rows = df.withColumn("bucket", F.timestamp_seconds(F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000 / seconds) * seconds))
        sums = [F.count("*").alias("n"), *[F.sum(v).cast("bigint").alias(v) for v in values]]
        sets = [[F.col("bucket")], *[[F.col("bucket"), F.col(b)] for b in by]]
        flags = [F.grouping(b).alias(f"__g_{b}") for b in by]
        grouped = rows.groupingSets(sets, "bucket", *by).agg(*sums, *flags)
        total = reduce(lambda a, b: a & b, [F.col(f"__g_{b}") == 1 for b in by], F.lit(True))
        named = reduce(lambda a, b: a | b, [(F.col(f"__g_{b}") == 0) & F.col(b).isNotNull() for b in by], F.lit(False))
        single = grouped.where(named)
        overall = grouped.where(total)
        spine = rows.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("bucket"))
        filled = spine.join(overall, "bucket", "left").na.fill(0, ["n", *values])
        out.append(filled.unionByName(single).select(F.lit(width).alias("width"), "bucket", *by, "n", *values))
    return reduce(lambda a, b: a.unionByName(b), out)


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def around_events(df: DataFrame, events: DataFrame, time: str, before_s: int, after_s: int) -> DataFrame:
    """Rows near each event (event, at): with rel_s, the seconds from it. The events are the bounded side; both are bucketed by the window's length."""
    width = before_s + after_s
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = events.withColumn("__b", F.explode(F.sequence(F.floor((sec("at") - before_s) / width), F.floor((sec("at") + after_s) / width))))
    rows = df.withColumn("__b", F.floor(sec(time) / width))
    return rows.join(e, "__b").withColumn("rel_s", sec(time) - sec("at")).where(F.col("rel_s").between(-before_s, after_s)).drop("__b")


def weighted_moments(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """n, mean, sample deviation and quartile distance of values repeated by an integer weight (deviation null for n below 2)."""
    x, c = F.col(value).cast("double"), F.col(weight)
    sums = df.where(c > 0).groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * x).alias("__s"), F.sum(c * x * x).alias("__q"))
    quarters = exact_quantiles(df, by, value, [0.25, 0.75], weight).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("quantiles").alias("__p"))
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    sums = sums.join(quarters, same, "left")
    variance = (F.col("__q") - F.col("__s") * F.col("__s") / F.col("n")) / (F.col("n") - 1)
    return sums.select(*by, "n", (F.col("__s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sd"), (F.col("__p")[1] - F.col("__p")[0]).alias("iqr"))


def ecdf(df: DataFrame, by: list[str], value: str, step: float, points: int) -> DataFrame:
    """The cumulative distribution of each group on the grid 0, step, 2 step, ...: by, point, value (share of items <= the grid point).

    Items are counted by the first grid point that covers them, then summed along the grid; items beyond its end count only in the total."""
    at = F.greatest(F.ceil(F.col(value) / step), F.lit(0)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, at.alias("point")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("__n"))
    grid = totals.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    w = Window.partitionBy(*by).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(counts, [*by, "point"], "left")
    return joined.select(*by, "point", (F.coalesce(F.sum("c").over(w), F.lit(0)) / F.col("__n")).alias("value"))


def mean_curve(curves: DataFrame, by: list[str]) -> DataFrame:
    """The mean of many curves at each point."""
    return curves.groupBy(*by, "point").agg(F.avg("value").alias("value"), F.count("*").alias("n_curves"))


def event_rates(items: DataFrame, story: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Per story the share of its items in which each pattern occurs."""
    return items.groupBy(story).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(text).rlike(p).cast("int"), F.lit(0))).alias(k) for k, p in patterns.items()])


def pivot_by_side(df: DataFrame, by: list[str], kind: str, side: str, value: str, kinds: list[str], sides: list[str]) -> DataFrame:
    """Long counts as a column for each kind and side (kind_side), 0 where there is none; kinds and sides beyond those named are left out."""
    column = lambda k, s: F.coalesce(F.sum(F.when((F.col(kind) == k) & (F.col(side) == s), F.col(value))), F.lit(0)).alias(f"{k}_{s}")
    return df.groupBy(*by).agg(*[column(k, s) for k in kinds for s in sides])
