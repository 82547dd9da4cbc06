"""Problem 5: records equal but for formatting, collapsed by recursive radix partitioning and counting tries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.storage import materialize

STRIDE = 32
FIRST_LENGTH = 8
GROUPED = "id bigint, keep_id bigint, hot_key binary"


def letters_and_digits(text: Column) -> Column:
    """Text without case and without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _canonical_value(value) -> str:
    if isinstance(value, str):
        return "s" + "".join(c for c in value.lower() if c.isalnum())
    if isinstance(value, bool) or value is None:
        return f"c{value}"
    if isinstance(value, (int, float)):
        whole = int(value) if isinstance(value, int) or (value == value and abs(value) != float("inf") and value == int(value)) else None
        return f"n{whole}" if whole is not None else f"n{value!r}"
    if isinstance(value, list):
        return "[" + "\x01".join(map(_canonical_value, value)) + "]"
    return "{" + "\x01".join(f"{k}\x02{_canonical_value(v)}" for k, v in sorted(value.items())) + "}"


def canonical_json(text: str | None) -> str | None:
    """One spelling of a JSON object: fields in order of name, strings without case and anything but letters and digits, equal numbers
    alike (1, 1.0, 1e0). Null for text that is no JSON object."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return _canonical_value(value) if isinstance(value, dict) else None


def _json_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical_json(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "canon"])


def json_canon(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(json_col).alias("j")).mapInArrow(_json_rows, "id bigint, canon string")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one trie a bucket, its edges STRIDE characters; a terminal holds the smallest id, the counter and, for a text spread over several tries, its digest."""
    bucket, trie, members = None, {}, []

    def emit() -> pa.RecordBatch:
        rows = [(i, t[0], t[2]) for i, t in members if t[1] > 1 or t[2] is not None]
        ids, keeps, keys = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keeps, pa.int64()), pa.array(keys, pa.binary())], names=["id", "keep_id", "hot_key"])

    for batch in batches:
        ids, canons, buckets, hots = (c.to_pylist() for c in batch.columns)
        for i, canon, b, hot in zip(ids, canons, buckets, hots):
            if b != bucket:
                if members:
                    yield emit()
                bucket, trie, members = b, {}, []
            node = trie
            for at in range(0, len(canon), STRIDE):
                edge = canon[at : at + STRIDE]
                below = node.get(edge)
                if below is None:
                    below = node[edge] = {}
                node = below
            terminal = node.get(None)
            if terminal is None:
                node[None] = terminal = [i, 1, hashlib.blake2b(canon.encode("utf-8", "surrogatepass"), digest_size=16).digest() if hot else None]
            else:
                terminal[1] += 1
                if i < terminal[0]:
                    terminal[0] = i
            members.append((i, terminal))
    if members:
        yield emit()


def _bucketed(stored: DataFrame, bucket_rows: int, bucket_chars: int) -> DataFrame:
    """id, canon, bucket and hot: each row with the bucket of its shortest prefix that is not oversized, the rows of one oversized text (hot) with one of its parts.

    The prefixes above the limits are a table at every level, joined to the rows that are left, and only these go on to the next."""
    done: list[DataFrame] = []
    left, length = stored, FIRST_LENGTH
    while True:
        rows = left.withColumn("prefix", F.substring("canon", 1, length))
        sizes = rows.groupBy("prefix").agg(F.count("*").alias("n"), F.sum(F.length("canon")).alias("chars"), F.max(F.length("canon")).alias("longest"))
        over = materialize(sizes.where((F.col("n") > bucket_rows) | ((F.col("chars") > bucket_chars) & (F.col("n") > 1))).select("prefix", (F.col("longest") <= length).alias("whole"), F.greatest(F.ceil(F.col("n") / bucket_rows), F.ceil(F.col("chars") / bucket_chars)).cast("int").alias("parts")), "oversized")
        if over.isEmpty():
            done.append(rows.select("id", "canon", F.xxhash64("prefix").alias("bucket"), F.lit(False).alias("hot")))
            break
        rows = rows.join(over, "prefix", "left")
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        done.append(rows.where("parts is null or whole").select("id", "canon", F.when(F.col("whole"), F.xxhash64("prefix", part)).otherwise(F.xxhash64("prefix")).alias("bucket"), F.coalesce("whole", F.lit(False)).alias("hot")))
        left = materialize(rows.where("not whole").select("id", "canon"), "left")
        length *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def groups_of_copies(rows: DataFrame, bucket_rows: int = 50_000, bucket_chars: int = 50_000_000) -> DataFrame:
    """Rows (id, canon: canonical text) that share their canonical text with another: id, keep_id (the smallest id of the group).

    Rows are spread by prefixes of the canonical text; prefixes with more than `bucket_rows` rows or `bucket_chars` characters are split by twice as many characters, again and
    again, until each bucket fits a trie in memory, whatever the size of the table, or is a single text. Such a text (a hot group) is spread by id over as many parts as it
    needs, counted in as many tries, and their smallest ids are then joined.
    Repeated ids count once (the smallest text, should copies differ); null ids and texts are no rows; an empty table gives no groups."""
    spark = rows.sparkSession
    once = rows.where(F.col("id").isNotNull() & F.col("canon").isNotNull()).groupBy("id").agg(F.min("canon").alias("canon"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bucketed = _bucketed(materialize(once, "canon"), bucket_rows, bucket_chars)
    grouped = materialize(bucketed.repartition(n, "bucket").sortWithinPartitions("bucket").select("id", "canon", "bucket", "hot").mapInArrow(_count, GROUPED), "tries")
    spread = grouped.where(F.col("hot_key").isNotNull())
    # One row a hot text, of which there are at most rows / bucket_rows; small enough to be sent out or not, as its written size tells the planner.
    firsts = materialize(spread.groupBy("hot_key").agg(F.min("keep_id").alias("first")), "firsts")
    return grouped.where(F.col("hot_key").isNull()).select("id", "keep_id").unionByName(spread.join(firsts, "hot_key").select("id", F.col("first").alias("keep_id")))


def copy_pairs(rows: DataFrame, **limits: int) -> DataFrame:
    """keep_id and copy_id: one row for each member of a group but the one kept."""
    return groups_of_copies(rows, **limits).where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))


def collapsed(rows: DataFrame, **limits: int) -> DataFrame:
    """One row per different text: keep_id and n_copies (1 for a text that occurs once)."""
    ids = rows.where(F.col("id").isNotNull() & F.col("canon").isNotNull()).select("id").distinct()
    groups = groups_of_copies(rows, **limits)
    return ids.join(groups, "id", "left").groupBy(F.coalesce("keep_id", "id").alias("keep_id")).agg(F.count("*").alias("n_copies"))
