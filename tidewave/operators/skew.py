"""Keys that hold most rows: exact per-key results and joins without one overloaded task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTIAL = "key_name string, key_value bigint, part int, seq bigint, rows bigint, sums array<bigint>, n_second bigint, first_second string, last_second string"


def _partials(n_sums: int):
    """mapInArrow body over rows sorted by (key_name, key_value, second): one partial state per key of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_state: list | None = None
        seq = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.table(batch)
            # Ranks of the sorted strings: equal neighbours are equal values, nulls are a value of their own.
            def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
                column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                null = np.asarray(column.is_null())
                code = np.asarray(column.dictionary_encode().indices.fill_null(-1))
                return code, null

            name, _ = codes(table["key_name"])
            value, _ = codes(table["key_value"])
            second, second_null = codes(table["second"])
            new_key = np.ones(n, bool)
            new_key[1:] = (name[1:] != name[:-1]) | (value[1:] != value[:-1])
            new_second = new_key.copy()
            new_second[1:] |= second[1:] != second[:-1]
            new_second &= ~second_null
            starts = np.flatnonzero(new_key)
            ends = np.append(starts[1:], n)
            rows = ends - starts
            sums = [np.add.reduceat(np.asarray(table[f"sum_{i}"].fill_null(0)), starts) for i in range(n_sums)]
            seconds = np.add.reduceat(new_second.astype(np.int64), starts)
            names, values, labels = table["key_name"], table["key_value"], table["second"]
            states = []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                # Nulls sort first, so the first label is the first one that starts in the group.
                at = a + int(np.argmax(new_second[a:b])) if seconds[i] else None
                states.append([names[a].as_py(), values[a].as_py(), int(rows[i]), [int(s[i]) for s in sums], int(seconds[i]), labels[at].as_py() if at is not None else None, labels[b - 1].as_py() if at is not None else None])
            done = []
            for state in states:
                if open_state and open_state[:2] == state[:2]:
                    same = open_state[6] is not None and open_state[6] == state[5]
                    open_state = [*open_state[:2], open_state[2] + state[2], [x + y for x, y in zip(open_state[3], state[3])], open_state[4] + state[4] - same, open_state[5] if open_state[5] is not None else state[5], state[6] if state[6] is not None else open_state[6]]
                else:
                    if open_state:
                        done.append(open_state)
                    open_state = state
            if done:
                yield _to_batch(done, part, seq)
                seq += len(done)
        if open_state:
            yield _to_batch([open_state], part, seq)

    return run


def _to_batch(states: list[list], part: int, seq: int) -> pa.RecordBatch:
    cols = list(zip(*states))
    n = len(states)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()),
            pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string()),
        ],
        names=["key_name", "key_value", "part", "seq", "rows", "sums", "n_second", "first_second", "last_second"],
    )


def totals_by_key(df: DataFrame, id_col: str, keys: list[str], second: str, sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Exact totals for every value of every key column, however unevenly the rows are spread over them.

    Records are counted once by `id_col`; where copies of an id differ, the smallest row (columns in order) counts.
    The records of all keys are range partitioned on (key, `second`, id) with sampled quantiles, so a heavy key is cut
    into as many partitions as its rows need; each partition yields one partial state per key it holds, and the states
    of a key are stitched at the partition boundaries: a `second` value on both sides of a boundary counts once.
    A key thus sends as many rows to the last step as partitions hold a part of it, never its records.

    Returns key_name, key_value (null keys form a group of their own), n_rows, n_distinct (non-null values of
    `second`) and one column for each of `sums` (integers; nulls count 0). An empty table gives no rows; columns of
    `df` that are not named are ignored, so extra or clashing ones do no harm.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = list(sums)
    narrow = df.select(
        F.col(id_col).alias("id"),
        F.struct(*[F.col(k).cast("bigint").alias(f"key_{i}") for i, k in enumerate(keys)], F.col(second).cast("string").alias("second"), *[F.coalesce(sums[s].cast("bigint"), F.lit(0)).alias(f"sum_{i}") for i, s in enumerate(names)]).alias("r"),
    )
    once = narrow.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("r").alias("r"))
    by_key = once.select(
        "id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(f"r.key_{i}").alias("key_value")) for i, k in enumerate(keys)])).alias("k"),
        F.col("r.second").alias("second"),
        *[F.col(f"r.sum_{i}").alias(f"sum_{i}") for i in range(len(names))],
    ).select("k.key_name", "k.key_value", "second", "id", *[f"sum_{i}" for i in range(len(names))])
    order = ["key_name", "key_value", "second", "id"]
    parts = by_key.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("id").mapInArrow(_partials(len(names)), PARTIAL)
    before = Window.partitionBy("key_name", "key_value").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    stitched = parts.withColumn("again", F.coalesce((F.last("last_second", ignorenulls=True).over(before) == F.col("first_second")).cast("int"), F.lit(0)))
    return stitched.groupBy("key_name", "key_value").agg(
        F.sum("rows").alias("n_rows"),
        F.sum(F.col("n_second") - F.col("again")).alias("n_distinct"),
        *[F.sum(F.element_at("sums", i + 1)).alias(s) for i, s in enumerate(names)],
    )


def heavy_keys(totals: DataFrame, of_key: str, share: float) -> DataFrame:
    """The keys of `totals_by_key` that hold more than `share` of all records; the total is that of the key `of_key`,
    which every record has once (null included)."""
    all_rows = totals.where(F.col("key_name") == of_key).agg(F.sum("n_rows"))
    return totals.where(F.col("key_value").isNotNull() & (F.col("n_rows") > all_rows.scalar() * F.lit(share)))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, hot_rows: int = 20000) -> DataFrame:
    """Inner equi-join on `keys` plus `condition`, in which a key with more than `hot_rows` rows on a side is cut into parts of about that size on that side, each
    meeting a copy of the rows, or of every part, of the other.

    Parts are chosen by a hash of the row, so a task run again makes the same choice; rows of either side should be distinct.
    `left` and `right` share only the names in `keys`. The tables of hot keys have at most rows / hot_rows rows of
    the bare keys, so the planner may broadcast them; nothing else is replicated. Null keys match nothing."""
    hot = lambda side, n: side.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias(n))
    parts = hot(left, "_lparts").join(hot(right, "_rparts"), keys, "full")
    one = lambda n: F.coalesce(n, F.lit(1))
    own = lambda side, n: F.pmod(F.xxhash64(*side.columns), one(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    l = left.join(parts, keys, "left").withColumn("_l", own(left, "_lparts")).withColumn("_r", all_of("_rparts")).drop("_lparts", "_rparts")
    r = right.join(parts, keys, "left").withColumn("_r", own(right, "_rparts")).withColumn("_l", all_of("_lparts")).drop("_lparts", "_rparts")
    return l.join(r, [*keys, "_l", "_r"]).where(condition).drop("_l", "_r")
