"""Problem 1: occurrences and records of every term, kept up to date by signed deltas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.storage import release_path, shared_path

SPACE = r"[ \t\n\r\f\x0B]+"
STATE = "src_table string, term string, n_occurrences bigint, n_records bigint"


def terms_of(content: Column) -> Column:
    """The non-empty pieces of lower-cased text between ASCII white space, in order of their bytes; null for null."""
    return F.array_remove(F.sort_array(F.split(F.lower(content), SPACE)), "")


def signed_counts(changes: DataFrame) -> DataFrame:
    """Changes (src_table, old, new: the content before and after, null where the record is or was not there) as signed changes of counts.

    Each content is read as a sorted list of its terms: every entry is an occurrence, one that differs from the entry before it also a
    record. Both are summed with the sign of the side before anything is shuffled. The row with a null term counts the records themselves."""
    sides = changes.select("src_table", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("content")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("content")))).alias("side"))
    sides = sides.where(F.col("side.content").isNotNull()).select("src_table", "side.sign", terms_of(F.col("side.content")).alias("terms"))
    # A null entry stands for the record itself and is the entry before its first term.
    none = F.array(F.lit(None).cast("string"))
    sides = sides.withColumn("term", F.concat(none, "terms")).withColumn("before", F.slice(F.concat(none, none, "terms"), F.lit(1), F.size("terms") + 1))
    rows = sides.select("src_table", "sign", F.inline(F.arrays_zip("term", "before")))
    first = ~F.col("term").eqNullSafe(F.col("before")) | F.col("term").isNull()
    return rows.groupBy("src_table", "term").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("sign")).otherwise(0)).cast("bigint").alias("n_occurrences"), F.sum(F.when(first, F.col("sign")).otherwise(0)).cast("bigint").alias("n_records"))


class TermCounts:
    """Counts of all terms in a folder all executors share, in partitions (buckets) by a hash of the term.

    `apply` reads only the records that were added, changed or deleted and rewrites only the buckets their terms fall
    into. Each version has a manifest of its own, which names the version every bucket was last written in and appears under its name in one rename, after the data: a job that
    dies at any moment leaves the version before it. Buckets are doubled as soon as they would hold more than `bucket_rows` terms on average; that rewrites
    all of them, but ever more rarely as the state grows."""

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = 1_000_000, least_buckets: int = 16):
        self.spark, self.path, self.bucket_rows = spark, path or shared_path(spark, "terms"), bucket_rows
        self.version, self.at, self.buckets, self.batches = 0, {}, least_buckets, []
        versions = self._versions()
        if versions:
            said = json.loads(spark.read.text(f"{self.path}/manifest-{max(versions)}.json", wholetext=True).first()[0])
            self.version, self.at, self.buckets, self.batches = said["version"], {int(k): v for k, v in said["at"].items()}, said["buckets"], said["batches"]

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self) -> list[int]:
        """The versions with a whole manifest."""
        fs, where = self._file("manifest-*.json")
        return [int(f.getPath().getName().removeprefix("manifest-").removesuffix(".json")) for f in fs.globStatus(where) or []]

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/v{self.at[b]}/bucket={b}" for b in buckets if b in self.at]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def counts(self) -> DataFrame:
        """src_table, term, n_occurrences, n_records; the row with a null term has the table's number of records."""
        return self._read(sorted(self.at))

    def apply(self, changes: DataFrame, batch: str | None = None) -> TermCounts:
        """Add the signed counts of `changes` (src_table, old, new; any number of rows, none included). A `batch` applied before changes nothing, so a job may be repeated."""
        if batch is not None and batch in self.batches:
            return self
        version = self.version + 1
        staged = f"{self.path}/delta{version}"
        signed_counts(changes).write.mode("overwrite").parquet(staged)
        delta = self.spark.read.schema(STATE).parquet(staged)
        buckets = self.buckets
        while self.counts().count() + delta.count() > buckets * self.bucket_rows:  # row counts of file footers
            buckets *= 2
        bucket = F.pmod(F.xxhash64(F.coalesce("term", F.lit(""))), F.lit(buckets)).cast("int")
        if buckets == self.buckets and self.at:
            touched = sorted(r[0] for r in delta.select(bucket.alias("b")).distinct().collect())  # at most `buckets` rows
            old = self._read(touched)
        else:
            touched, old = list(range(buckets)), self.counts()
        merged = old.unionByName(delta).groupBy("src_table", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records")) if self.at else delta
        kept = merged.where(F.col("n_records") != 0).withColumn("bucket", bucket)
        kept.repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        at = dict(self.at) if buckets == self.buckets else {}
        for b in touched:
            fs, where = self._file(f"v{version}/bucket={b}")
            if fs.exists(where):
                at[b] = version
            else:
                at.pop(b, None)
        self._commit(version, at, buckets, [*self.batches, batch] if batch is not None else self.batches)
        release_path(self.spark, staged)
        return self

    def _commit(self, version: int, at: dict[int, int], buckets: int, batches: list[str]) -> None:
        said = json.dumps({"version": version, "buckets": buckets, "at": at, "batches": batches})
        fs, draft = self._file(f"draft-{version}")
        out = fs.create(draft, True)
        out.write(bytearray(said.encode()))
        out.close()
        _, final = self._file(f"manifest-{version}.json")
        if not fs.rename(draft, final):
            raise OSError(f"version {version} of {self.path} was written by another job")
        self.version, self.at, self.buckets, self.batches = version, at, buckets, batches


def marked(counts: DataFrame, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """Terms with mark 'rare' (in fewer than `rare_below` records of their table), 'common' (in more than `common_above` of
    them, empty records included) or null."""
    totals = counts.where(F.col("term").isNull()).select("src_table", F.col("n_records").alias("table_records"))
    terms = counts.where(F.col("term").isNotNull()).join(F.broadcast(totals), "src_table")  # one row a table
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.col("table_records") * common_above, "common")
    return terms.withColumn("mark", mark).drop("table_records")


def versions(records: DataFrame, id_col: str, content_col: str, order_col: str, cut: Column, src_table: str) -> DataFrame:
    """One row per record id: its content as delivered up to `cut` (old) and after it (new), the last delivery of each side.

    A delivered null content is an empty record; a side without a delivery is null."""
    content = F.coalesce(F.col(content_col), F.lit(""))
    early = F.coalesce(F.col(order_col) <= cut, F.lit(True))
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.when(early, F.struct(F.col(order_col).alias("o"), content.alias("c"))).alias("old"), F.when(~early, F.struct(F.col(order_col).alias("o"), content.alias("c"))).alias("new"))
    return rows.groupBy("id").agg(F.max("old").alias("old"), F.max("new").alias("new")).select(F.lit(src_table).alias("src_table"), F.col("old.c").alias("old"), F.col("new.c").alias("new"))


def counted_in_two_loads(spark: SparkSession, tables: list[tuple[DataFrame, str, str, str, str]], history_days: int = 7) -> TermCounts:
    """The state after a first load of all deliveries but those of the last `history_days`, and a delta of these.

    tables: (records, id column, content column, delivery time column, name). A record delivered in both parts is a change."""
    from tidewave.storage import materialize

    parts = []
    for records, id_col, content_col, order_col, name in tables:
        last = records.agg(F.max(order_col)).first()[0]
        cut = F.lit(last).cast("timestamp") - F.expr(f"interval {int(history_days)} days") if last is not None else F.lit(None).cast("timestamp")
        parts.append(versions(records, id_col, content_col, order_col, cut, name))
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    both = materialize(both, "versions")
    state = TermCounts(spark)
    state.apply(both.select("src_table", F.lit(None).cast("string").alias("old"), F.col("old").alias("new")).where(F.col("new").isNotNull()))
    return state.apply(both.where(F.col("new").isNotNull()))
