"""Files in and out: delimited text, JSON lines, transcripts, vectors, edge lists."""

from __future__ import annotations

import gzip
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
# Recognizer lines that say nothing.
STOP_LINES = ["[noise]", "[noise] [noise]", "<unk>", "[laughter]", "thank you", "mm", "and", "the", "thanks", "a", "[noise] [noise] [noise]", "oh", "um", "i", "na"]


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, **options: str) -> DataFrame:
    """CSV or TSV, plain or compressed by extension; without a schema all columns are text named by the header."""
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", options.pop("multiLine", "false")).option("escape", '"').options(**options)
    return (reader.schema(schema) if schema else reader).csv(path)


def append_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Append rows to a parquet table, in the columns given."""
    (df.select(*columns) if columns else df).write.mode("append").parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", compression: str = "gzip") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').option("compression", compression).csv(path)


def rows_of(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """Rows one partition at a time, restartable: each call scans anew; the driver holds one partition."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with a schema; `strict` fails on a bad line, else its text stands in the column `_corrupt`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def json_lines_to_columns(lines: DataFrame, json_col: str, strict: bool = True) -> tuple[DataFrame, list[str]]:
    """JSON objects to text columns named by the first object's fields; `strict` raises if another has a field beyond them."""
    fields = F.json_object_keys(json_col)
    first = lines.select(fields.alias("k")).where("k is not null").first()
    names = list(first[0]) if first else []
    if strict:
        extra = lines.select(F.explode(F.array_except(fields, F.array(*[F.lit(n) for n in names]).cast("array<string>"))).alias("f")).limit(1).collect()
        if extra:
            raise ValueError(f"a later record has the field {extra[0][0]!r}")
    return lines.select(*[c for c in lines.columns if c != json_col], *[F.get_json_object(json_col, f"$.{n}").alias(n) for n in names]), names


def bad_json_lines(spark: SparkSession, path: str | list[str], stop: bool = False) -> DataFrame:
    """file, line_no (from 1) and text of every line that is not JSON; `stop` raises at the first.

    Lines are numbered by the row index the text source keeps for each file, without a shuffle of the text."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    from pyspark.sql import Window

    before = first.withColumn("skip", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bad = lines.where(F.try_parse_json("value").isNull() & (F.trim("value") != "")).withColumn("part", F.shiftright("at", 33))
    out = bad.join(before, ["file", "part"]).select("file", (F.col("at") - F.col("from") + F.col("skip") + 1).alias("line_no"), F.col("value").alias("text"))
    if stop and (found := out.limit(1).collect()):
        raise ValueError(f"{found[0].file}:{found[0].line_no}")
    return out


def without_keys(json: Column, keys: list[str]) -> Column:
    """A flat JSON object without some of its fields."""
    as_map = F.from_json(json, "map<string,string>")
    return F.to_json(F.map_filter(as_map, lambda k, _: ~k.isin(keys)))


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and length of every file below, each once, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").distinct().orderBy("path")


def clean_json_lines(lines: DataFrame, col: str, injected: str, schema: str) -> DataFrame:
    """Lines from which an injected control record is cut out by pattern; what then still is not JSON is dropped."""
    fixed = lines.withColumn(col, F.regexp_replace(col, injected, ""))
    parsed = fixed.withColumn("__j", F.from_json(col, schema + f", {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    return parsed.where(F.col("__j").isNotNull() & F.col(f"__j.{CORRUPT}").isNull()).select(*[c for c in lines.columns if c != col], "__j.*").drop(CORRUPT)


def read_parts(spark: SparkSession, path: str, schema: str, skip_prefix: str | None = None) -> DataFrame:
    """A folder of delimited parts, without those whose name begins with `skip_prefix`; empty files give no rows."""
    df = read_delimited(spark, path, schema)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.where(~name.startswith(skip_prefix)) if skip_prefix else df


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON files with segments, one row each: file, text; broken files are skipped."""
    docs = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema("segments array<struct<text:string>>").json(path)
    return docs.where("segments is not null").select(F.input_file_name().alias("file"), transcript_text(F.col("segments")).alias("text"))


def transcript_text(segments: Column) -> Column:
    return F.trim(F.array_join(F.transform(segments, lambda s: F.trim(s.text)), " "))


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors keyed by id, never by position."""
    df.write.mode("overwrite").parquet(path)


def write_edges(df: DataFrame, path: str, source: str = "source", target: str = "target") -> None:
    write_delimited(df.select(source, target), path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "source bigint, target bigint")


# -- recognizer files --------------------------------------------------------------------------------------------------

def key_station(key: Column) -> Column:
    """The fourth part of a key like a/b/2018-03-03/WXYZ/15_50_48.raw; 'unknown' for a shorter key."""
    return F.coalesce(F.get(F.split(key, "/"), F.lit(3)), F.lit("unknown"))


def key_date(key: Column) -> Column:
    return F.get(F.split(key, "/"), F.lit(2))


def key_timestamp(key: Column) -> Column:
    """'2018-03-03 15:50:48' from such a key."""
    clock = F.replace(F.get(F.split(F.get(F.split(key, "/"), F.lit(4)), r"\."), F.lit(0)), F.lit("_"), F.lit(":"))
    return F.concat(key_date(key), F.lit(" "), clock)


def words_of_tsv(text: Column) -> Column:
    """Lines of word, start and stop as an array of structs; lines of any other width are left out."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda line: F.split(line, "\t")), lambda r: F.size(r) == 3)
    return F.transform(rows, lambda r: F.struct(r[0].alias("word"), r[1].cast("double").alias("start"), r[2].cast("double").alias("stop")))


# -- tables ------------------------------------------------------------------------------------------------------------

def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, references: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """The constraints a warehouse would enforce, as counts of what breaks them: constraint, n."""
    out = []
    for c in not_null:
        out.append(df.where(F.col(c).isNull()).agg(F.count("*").alias("n")).select(F.lit(f"{c} not null").alias("constraint"), "n"))
    for cols in unique:
        out.append(df.groupBy(*cols).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"unique {', '.join(cols)}").alias("constraint"), "n"))
    for name, test in (checks or {}).items():
        out.append(df.where(~test).agg(F.count("*").alias("n")).select(F.lit(f"check {name}").alias("constraint"), "n"))
    for c, other, key in references:
        out.append(df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias(c)).distinct(), c, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{c} references {key}").alias("constraint"), "n"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def read_matrix(path: str, id_name: str = "id", value_name: str = "embedding"):
    """A matrix from an .npy file as a local table (id: the row's number, value: an array), for matrices that fit the driver; larger ones are kept as parquet with an array column."""
    import numpy as np
    import pyarrow as pa

    m = np.load(path, allow_pickle=False)
    if m.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    flat = pa.array(np.ascontiguousarray(m).reshape(-1))
    return pa.table({id_name: pa.array(range(len(m)), pa.int64()), value_name: pa.FixedSizeListArray.from_arrays(flat, m.shape[1]).cast(pa.list_(flat.type))})


def activity_fields(activities: DataFrame) -> DataFrame:
    """Nested activities (id, actor.id, generator.displayName, inReplyTo) as columns: id and user_id as numbers behind their prefixes, source, is_reply; the other columns stay."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint")
    rest = [c for c in activities.columns if c not in ("id", "actor", "generator", "inReplyTo")]
    return activities.select(number(F.col("id")).alias("id"), number(F.col("actor.id")).alias("user_id"), F.col("generator.displayName").alias("source"), F.col("inReplyTo").isNotNull().alias("is_reply"), *rest)


def without_stop_lines(df: DataFrame, text: str, lines: list[str] = STOP_LINES) -> DataFrame:
    """Rows whose text is not one of a fixed list of lines; null texts are left out."""
    return df.where(~F.col(text).isin(lines))


def replication_ids(items: DataFrame, kind: str, value: str, id_col: str, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """The distinct ids of one kind of items, as numbers without their prefix, with the columns of `keep` and nothing else: a set that can be published. Ids that are no number are left out."""
    number = F.regexp_extract(id_col, rf"^{prefix}(\d+)$", 1).try_cast("bigint")
    return items.where(F.col(kind) == value).select(number.alias("id"), *(keep or [])).where("id is not null").distinct()


def sampled_batches(df: DataFrame, key: str, fraction: float, size: int, seed: int = 0) -> Iterator[list[Row]]:
    """A sample of `fraction` of the rows, decided by their key, in lists of `size` rows (the last may be shorter); the driver holds one partition at a time."""
    from itertools import islice

    from tidewave.operators.windows import bernoulli

    rows = iter(rows_of(bernoulli(df, key, fraction, seed)))
    while batch := list(islice(rows, size)):
        yield batch


@contextmanager
def text_stream(path: str = "-", write: bool = False) -> Iterator[IO[str]]:
    """A small text file for the driver's own use: plain, gzip by its name, or '-' for the standard streams, which stay open. Tables are read by Spark, compressed or not."""
    if path == "-":
        yield sys.stdout if write else sys.stdin
        return
    with (gzip.open if path.lower().endswith(".gz") else open)(path, "wt" if write else "rt", encoding="utf-8") as f:
        yield f


def create_table_as(df: DataFrame, name: str, partition_by: list[str] | None = None, replace: bool = False) -> DataFrame:
    """A managed parquet table from a frame, read back; with `replace` instead of one of that name, else its presence is an error."""
    writer = df.write.format("parquet").mode("overwrite" if replace else "error")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def truncate_table(spark: SparkSession, name: str) -> None:
    """All rows of a managed table away, its schema kept."""
    spark.sql(f"truncate table {name}")
