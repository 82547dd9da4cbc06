"""The folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset: a temporary folder on a local master, whose executors are this machine; an error on any other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidewave-")
    return _OWN[app]


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which is deleted when the application ends."""
    app = f"{shared_dir(spark)}/tidewave/{spark.sparkContext.applicationId}"
    if app not in _MARKED:
        fs, where = _file(spark, app)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _MARKED.add(app)
    return f"{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: survives lost executors, computed once. `release` deletes it sooner than the application's end."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def release(*frames: DataFrame | None) -> None:
    """Delete the tables of frames from `materialize` that no plan reads any more, as in the earlier rounds of a loop; other frames are left alone."""
    for frame in frames:
        path = getattr(frame, "_stored_at", None)
        if path:
            release_path(frame.sparkSession, path)


def release_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    fs, where = _file(spark, path)
    fs.delete(where, True)
