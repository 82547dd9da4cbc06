"""Joins on bands, intervals, schedules and shared neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.skew import salted_join


def within_days(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Rows with equal keys less than `days` days apart. Buckets of `days` days join the equality, so a key with a long history is not
    compared with all of itself: a left row meets its own bucket and the two beside it."""
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    l = left.withColumn("__b", F.explode(F.array(*[bucket(left_day) + i for i in (-1, 0, 1)])))
    r = right.withColumn("__b", bucket(right_day))
    return l.join(r, [*keys, "__b"]).where(F.abs(F.datediff(F.col(left_day), F.col(right_day))) < days).drop("__b")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, condition: Column | None = None) -> DataFrame:
    """Rows with equal keys whose intervals overlap strictly: left (start1, end1), right (start2, end2), numbers.

    Both sides are put into the buckets of `width` they touch; a pair is made only in the first bucket both touch, so none repeats and the
    join is an equi-join. An empty interval on a border overlaps nothing, nor does one of length 0 overlap itself."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))
    l = left.withColumn("__b", F.explode(span("start1", "end1")))
    r = right.withColumn("__b", F.explode(span("start2", "end2")))
    test = (F.col("start2") < F.col("end1")) & (F.col("end2") > F.col("start1")) & (F.col("__b") == F.floor(F.greatest("start1", "start2") / width))
    return l.join(r, [*keys, "__b"]).where(test if condition is None else test & condition).drop("__b")


def schedule_lookup(items: DataFrame, schedule: DataFrame, station: str, minute: str) -> DataFrame:
    """The show on air for each item's station and minute of the week: schedule has station, from_minute, until_minute, show,
    confidence, row_no. The highest confidence wins, then the later row; the schedule is exploded to minutes (at most 10,080 a station)."""
    minutes = schedule.select(F.col("station").alias(station), F.explode(F.sequence("from_minute", F.col("until_minute") - 1)).alias(minute), "show", "confidence", "row_no")
    best = minutes.groupBy(station, minute).agg(F.max_by("show", F.struct("confidence", "row_no")).alias("show"), F.max("confidence").alias("schedule_confidence"))
    return items.join(best, [station, minute], "left")


def words_to_segments(words: DataFrame, segments: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Each word (key, word, start, confidence) to the first segment by start (key, segment_start, segment_end) with
    segment_start <= start < segment_end; words in gaps are dropped. A bucketed range join and one pre-aggregated group-by."""
    s = segments.select(key, "segment_start", "segment_end").withColumn("__b", F.explode(F.sequence(F.floor(F.col("segment_start") / width), F.floor(F.col("segment_end") / width))))
    w = words.withColumn("__b", F.floor(F.col("start") / width)).withColumn("__id", F.struct("start", "word"))
    hit = w.join(s, [key, "__b"]).where((F.col("segment_start") <= F.col("start")) & (F.col("start") < F.col("segment_end")))
    return hit.groupBy(key, *[c for c in words.columns if c != key]).agg(F.min(F.struct("segment_start", "segment_end")).alias("s")).select("*", "s.*").drop("s")


def mutual_counts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """For each pair (a, b): how many targets both point to, with repeated edges counted as often as on both sides (n_mutual, 0 kept).

    The edges of the pairs' members only; joined on (member, target), never member by member."""
    e = edges.groupBy("source", "target").agg(F.count("*").alias("c"))
    left = pairs.select("a", "b").distinct().join(e.select(F.col("source").alias("a"), "target", F.col("c").alias("c1")), "a")
    both = left.join(e.select(F.col("source").alias("b"), "target", F.col("c").alias("c2")), ["b", "target"])
    counts = both.groupBy("a", "b").agg(F.sum(F.least("c1", "c2")).alias("n_mutual"))
    return pairs.join(counts, ["a", "b"], "left").withColumn("n_mutual", F.coalesce("n_mutual", F.lit(0)))


def cooccurring(rows: DataFrame, item: str, group: list[str], least: int = 1, hot_rows: int = 5000) -> DataFrame:
    """Unordered pairs of items that share groups: item1 < item2, n_groups (at least `least`). A group of more than `hot_rows` items is cut into tiles of that size."""
    per = rows.select(*group, item).distinct()
    pairs = salted_join(per.withColumnRenamed(item, "item1"), per.withColumnRenamed(item, "item2"), group, F.col("item1") < F.col("item2"), hot_rows)
    return pairs.groupBy("item1", "item2").agg(F.count("*").alias("n_groups")).where(F.col("n_groups") >= least)


def full_outer(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Several tables of metrics by the same key, side by side, keys of any of them kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full")
    return out


def map_values(df: DataFrame, col: str, table: dict[str, str], default: str | None = None) -> DataFrame:
    """A column through a small dictionary."""
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.try_element_at(mapping, F.col(col)), F.lit(default)))


def running_groups(df: DataFrame, by: list[str], order: str, value: str, out: str = "group_no") -> DataFrame:
    """A number that rises at every non-null value, for filling gaps."""
    return df.withColumn(out, F.count(value).over(Window.partitionBy(*by).orderBy(order)))
