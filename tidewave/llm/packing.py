"""Problem 8: items into containers of fixed capacity by harmonic classes."""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = "item_id bigint, n_tokens bigint"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(os.path.basename(path)))
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def _lengths(path: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[int] = []
            group: list[str] = []
            size = 0
            # Encodings of a few texts at a time: a worker never holds those of a whole batch.
            for text in texts:
                group.append(text)
                size += len(text)
                if size >= chunk_chars:
                    out += [len(e.ids) for e in t.encode_batch_fast(group, add_special_tokens=False)]
                    group, size = [], 0
            out += [len(e.ids) for e in t.encode_batch_fast(group, add_special_tokens=False)] if group else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["item_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, chunk_chars: int = 200_000) -> DataFrame:
    """item_id and n_tokens of each text, by a public tokenizer file, which the driver reads and sends to the executors. A null text has 0 tokens, as has ''; null ids are no items."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_lengths(tokenizer, chunk_chars), SIZES)


def class_of(size: Column, capacity: int) -> Column:
    """The harmonic class k of a size in (capacity / (k + 1), capacity / k]: so many items of it fill a container of their own."""
    return F.floor(F.lit(capacity) / size).cast("bigint")


def grade_of(size: Column, capacity: int, grades: int) -> Column:
    """The largest size of the grade a size belongs to. Grades cut class k into `grades` / k steps of equal width at most (exact sizes while there are
    fewer), so there are about `grades` x ln(`grades`) of them, whatever the capacity, and none reaches into another class."""
    k = class_of(size, capacity)
    high, low = F.floor(F.lit(capacity) / k), F.floor(F.lit(capacity) / (k + 1))
    width = F.ceil((high - low) / F.least(high - low, F.greatest(F.floor(F.lit(grades) / k), F.lit(1))))
    return (high - F.floor((high - size) / width) * width).cast("bigint")


def fill_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Which sizes go together: [(containers, [(size, items a container)])], from the number of items of each size.

    Containers are opened class by class, from the largest items on: one takes floor(capacity / size) items of the largest size left, going on to smaller sizes
    of the class where there are too few, and then fills its rest in the same way with the largest sizes that fit it. A container opened by class k thus holds k items
    of the class, unless these run out: class k opens at most ceil(its items / k) containers, so there are never more containers than without filling.
    A pattern is kept for as many containers as the counts allow, and each ends some size, so the plan grows with the number of sizes, not of items."""
    left = dict(histogram)
    sizes = sorted(s for s, n in left.items() if n)
    plan = []
    while sizes:
        room, at, pattern = capacity, len(sizes), []
        while (at := bisect_right(sizes, room, 0, at) - 1) >= 0:
            size = sizes[at]
            take = min(room // size, left[size])
            pattern.append((size, take))
            room -= take * size
        bins = min(left[s] // k for s, k in pattern)
        for s, k in pattern:
            left[s] -= k * bins
        sizes = [s for s in sizes if left[s]]
        plan.append((bins, pattern))
    return plan


def _pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items as pieces of at most `capacity`: whole containers and a rest of those above it, others as they are."""
    once = sizes.where(F.col("item_id").isNotNull() & F.col("n_tokens").isNotNull()).groupBy("item_id").agg(F.max("n_tokens").alias("n_tokens"))
    full = F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(0)
    cut = once.select("item_id", F.explode(F.sequence(F.lit(0), full.cast("int"))).alias("piece"), full.alias("whole"), F.col("n_tokens").alias("all"))
    cut = cut.withColumn("n_tokens", F.when(F.col("piece") < F.col("whole"), F.lit(capacity)).otherwise(F.col("all") - F.col("whole") * capacity)).where((F.col("n_tokens") > 0) | (F.col("whole") == 0))
    return cut.select("item_id", "piece", F.col("n_tokens").cast("bigint").alias("n_tokens"))


def _placed(plan):
    """The container of each item: a binary search for the stretch of its grade that holds its running number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_grade, starts, first, firsts, each = plan.value
        for batch in batches:
            grade, no = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            at = np.searchsorted(starts, (np.searchsorted(of_grade, grade) << 44) + no, side="right") - 1
            container = firsts[at] + (no - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container, pa.int64())], names=["item_id", "piece", "n_tokens", "container_id"])

    return run


def packed(sizes: DataFrame, capacity: int = 1024, fill: bool = True, grades: int = 512) -> DataFrame:
    """Every item in containers: item_id, piece, n_tokens (of the piece), container_id; no container holds more than `capacity`.

    sizes: item_id, n_tokens. An item above the capacity, and no other, is split: into full containers of its own and a rest that is packed
    like an item. Items fall into harmonic classes: those of class k, in (capacity / (k + 1), capacity / k], go k to a container, and as an item's container is its running number
    in its class divided by k, workers fill containers independently and no item is moved to a common task. Without `fill` that is all, and no count is needed but one for each class.
    Class k then leaves up to 1 / (k + 1) of its containers empty; with `fill`, the rests take items of later classes, a fixed count of each grade (see grade_of) for
    each run of containers. That plan (fill_plan) is made on the number of items of each grade, about `grades` x ln(`grades`) numbers whatever the table and
    capacity, and never opens more containers than without it. Running numbers come from range partitions in order of grade: a count per partition and grade, then an offset each.
    Items of 0 tokens take no room: they share container 0, which holds nothing else. Null sizes are no items; a repeated id counts once (its largest size); an empty table gives no rows."""
    from tidewave.storage import materialize

    spark = sizes.sparkSession
    pieces = materialize(_pieces(sizes, capacity), "pieces")
    empty = pieces.where("n_tokens = 0").select("item_id", "piece", "n_tokens", F.lit(0).cast("bigint").alias("container_id"))
    real = pieces.where("n_tokens > 0")
    if not fill:
        numbered, counts = _running_numbers(real.withColumn("grade", class_of(F.col("n_tokens"), capacity)))
        opened = counts.groupBy("grade").agg(F.ceil(F.sum("c") / F.col("grade")).alias("bins"))
        # One row for each class, at most twice the root of the capacity.
        first = opened.select("grade", (F.coalesce(F.sum("bins").over(Window.partitionBy(F.lit(0)).orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("first"))
        return numbered.join(F.broadcast(first), "grade").select("item_id", "piece", "n_tokens", (F.col("first") + F.floor(F.col("no") / F.col("grade"))).alias("container_id")).unionByName(empty)
    numbered, counts = _running_numbers(real.withColumn("grade", grade_of(F.col("n_tokens"), capacity, grades)))
    histogram = {r[0]: r[1] for r in counts.groupBy("grade").agg(F.sum("c")).collect()}
    stretches: list[tuple[int, int, int, int]] = []
    first_bin, taken = 1, dict.fromkeys(histogram, 0)
    for bins, pattern in fill_plan(histogram, capacity):
        for size, k in pattern:
            stretches.append((size, taken[size], first_bin, k))
            taken[size] += k * bins
        first_bin += bins
    of_grade = np.array(sorted(histogram), np.int64)
    size, first, firsts, each = (np.array(x, np.int64) for x in zip(*sorted(stretches))) if stretches else (np.zeros(0, np.int64),) * 4
    plan = (of_grade, (np.searchsorted(of_grade, size) << 44) + first, first, firsts, each)
    placed = numbered.select("item_id", "piece", "n_tokens", "grade", "no").mapInArrow(_placed(spark.sparkContext.broadcast(plan)), "item_id bigint, piece int, n_tokens bigint, container_id bigint")
    return placed.unionByName(empty)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A running number within the partition and grade, over rows sorted by grade."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, next_no = None, 0
    for batch in batches:
        grade = np.asarray(batch.column(3))
        if not len(grade):
            continue
        new = np.flatnonzero(np.append(True, grade[1:] != grade[:-1]))
        no = np.arange(len(grade)) - np.repeat(new, np.diff(np.append(new, len(grade))))
        if grade[0] == last:
            no[: new[1] if len(new) > 1 else len(grade)] += next_no
        last, next_no = grade[-1], no[-1] + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(grade), part), pa.int32()), pa.array(no, pa.int64())], names=["item_id", "piece", "n_tokens", "grade", "part", "no"])


def _running_numbers(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers from 0 (no) within each grade, without bringing a grade together: range partitions, then an offset for each partition and grade.
    With them, the counts (grade, part, c)."""
    from tidewave.storage import materialize

    spark = pieces.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["grade", "item_id", "piece"]
    local = pieces.repartitionByRange(n, *order).sortWithinPartitions(*order).select("item_id", "piece", "n_tokens", "grade").mapInArrow(_numbers, "item_id bigint, piece int, n_tokens bigint, grade bigint, part int, no bigint")
    local = materialize(local, "numbers")
    counts = local.groupBy("grade", "part").agg(F.count("*").alias("c"))  # partitions are ranges of grades: grades + partitions rows
    before = Window.partitionBy("grade").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("grade", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"))
    return local.join(F.broadcast(offsets), ["grade", "part"]).select("item_id", "piece", "n_tokens", "grade", (F.col("no") + F.col("skip")).alias("no")), counts


def kept(sizes: DataFrame, containers: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row that tells whether a packing is right: n_items in containers, and how many containers are over capacity, items split that would fit, and items whose pieces
    do not add up to them (all 0 if it is)."""
    fills = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.coalesce(F.sum((F.col("t") > capacity).cast("bigint")), F.lit(0)).alias("n_overfull"))
    whole = containers.groupBy("item_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("pieces"))
    items = sizes.groupBy("item_id").agg(F.max("n_tokens").alias("n_tokens")).join(whole, "item_id", "full")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    items = items.agg(F.count("t").alias("n_items"), count((F.col("pieces") > 1) & (F.col("n_tokens") <= capacity)).alias("n_split"), count(~F.col("t").eqNullSafe(F.col("n_tokens"))).alias("n_wrong"))
    return items.join(fills, F.lit(True))  # one row each


def usage(containers: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: n_items, n_containers, n_tokens, used (share of the containers' room that is filled; the container of empty items aside)."""
    fills = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    real = F.col("container_id") > 0
    return fills.agg(F.sum("n").alias("n_pieces"), F.sum(real.cast("int")).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.try_divide(F.sum("t"), F.sum(real.cast("int")) * capacity).alias("used"))
