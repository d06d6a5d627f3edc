"""Tables that jobs leave for later jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.functions.text import hour_of

_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: that of the surrounding :func:`staging`,
    else ``spark.checkpoint.dir``, else one beside the warehouse's tables.

    On a cluster a warehouse on a local disk is refused: each machine would
    write to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if _folders or root:
        return (_folders[-1] if _folders else root).rstrip("/")
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
    one_machine = master.startswith("local") and not master.startswith("local-cluster")
    if not one_machine and warehouse.split(":")[0] in ("file", warehouse):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_staged"


@contextmanager
def staging(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Stage into a folder of its own under ``folder``, and remove it at the end.

    Results that read staged tables must be written or collected before.
    """
    own = f"{(folder or shared_dir(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
    _folders.append(own)
    try:
        yield own
    finally:
        _folders.remove(own)
        remove(spark, own)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Cuts the lineage, keeps column pruning for the readers and survives the
    loss of any executor.
    """
    return written(df, new_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a result to a new folder and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return [f.getPath().toString() for f in found or []]


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder with all it holds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, replaced if it is there, by whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_by_hour(df: DataFrame, path: str, ts: str = "ts", files_per_hour: int = 8) -> None:
    """Compact events to Parquet partitioned by hour, so hour ranges prune files.

    Rows of one hour spread over ``files_per_hour`` writers, because one busy
    hour may hold a large share of all rows. Hours already stored are replaced
    if they occur in ``df`` and kept otherwise.
    """
    spread = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(files_per_hour))
    (df.withColumn("hour", F.date_format(hour_of(F.col(ts)), "yyyy-MM-dd-HH"))
       .repartition("hour", spread)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
       .partitionBy("hour").parquet(path))


def read_by_hour(spark: SparkSession, path: str, start_hour: str | None = None,
                 end_hour: str | None = None) -> DataFrame:
    """Read ``[start_hour, end_hour)`` of a table written by :func:`write_by_hour`."""
    # Without the option the hour directory names could be read as dates.
    df = spark.read.option("partitionColumnTypeInference", "false").parquet(path)
    df = df.withColumn("hour", F.col("hour").cast("string"))
    if start_hour:
        df = df.filter(F.col("hour") >= start_hour)
    if end_hour:
        df = df.filter(F.col("hour") < end_hour)
    return df


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Save a lookup table bucketed and sorted by its keys.

    Commits and diffs saved with the same bucketing join without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
