"""Hourly JSON-lines event archives the user holds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate import schemas
from hushgate.functions.text import hour_of
from hushgate.sources.store import stage

HOUR_IN_PATH = r"(\d{4}-\d{2}-\d{2}-\d{1,2})(?!\d)"
CORRUPT = schemas.CORRUPT_COLUMN


def archive_hour_path(ts: Column) -> Column:
    """Archive file name of an hour."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd-HH"), F.lit(".json.gz"))


def hour_from_path(path: Column) -> Column:
    """Hour an archive path stands for; null when the path names none."""
    found = F.regexp_extract(path, HOUR_IN_PATH, 1)
    day = F.left(found, F.lit(10))
    hour = F.lpad(F.substring_index(found, "-", -1), 2, "0")
    return F.try_to_timestamp(F.concat(day, F.lit(" "), hour, F.lit(":00:00")),
                              F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def read_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines of the archives: parsed events, and bad lines kept as text.

    Gzip files do not split, so an hour file is one task; write_by_hour compacts
    them once for repeated use.
    """
    return _parsed(spark.read.text(paths).withColumn("archive_hour", hour_from_path(F.input_file_name())))


def _parsed(lines: DataFrame) -> DataFrame:
    event = F.from_json("value", schemas.RAW_EVENT_WITH_CORRUPT,
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.filter(F.trim("value") != "").select(event.alias("e"), "archive_hour").select("e.*", "archive_hour")


def read_archive_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Well-formed events only."""
    return read_archive(spark, paths).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that are not valid events, with the hour they came from."""
    return (read_archive(spark, paths)
            .select(F.col(CORRUPT).alias("line"), "archive_hour")
            .filter(F.col("line").isNotNull()))


#: Files of this size or more cannot be checked in one piece and are taken as they are.
MOST_CHECKED = (1 << 31) - 4096
_PIECE = 1 << 20


def gzip_fault(data: memoryview) -> str | None:
    """Why a gzip file cannot be read to its end, None if it can; never more than a piece is unpacked at a time."""
    at, members = 0, 0
    try:
        while at < len(data):
            unpack = zlib.decompressobj(wbits=31)
            while not unpack.eof:
                left = unpack.unconsumed_tail
                if not left:
                    if at >= len(data):
                        return "truncated"
                    left, at = data[at: at + _PIECE], at + _PIECE
                unpack.decompress(left, _PIECE)
            at = min(at, len(data)) - len(unpack.unused_data) - len(unpack.unconsumed_tail)
            members += 1
    except zlib.error:
        return "damaged" if members or bytes(data[:2]) == b"\x1f\x8b" else "not gzip"
    return None if members else "empty"


def archive_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every listed file: ``(path, archive_hour, bytes, error)``, without an error if it can be read to its end.

    Each gzip file is unpacked once in the task that reads it, so a damaged one
    is a row instead of the end of the run. Other files have nothing to check;
    Spark leaves files without any byte out of every listing.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    checked = F.col("path").endswith(".gz") & (F.col("length") < MOST_CHECKED)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, content in zip(*b.columns):
                fault = gzip_fault(memoryview(content.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([length.as_py()], pa.int64()), pa.array([fault], pa.string())],
                                                 names=["path", "bytes", "error"])

    faults = listed.filter(checked).select("path", "length", "content").mapInArrow(check, "path string, bytes long, error string")
    others = listed.filter(~checked).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("error"))
    return faults.unionByName(others).select("path", hour_from_path(F.col("path")).alias("archive_hour"), "bytes", "error")


def read_archive_safely(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """All lines of the files that can be read to their end, as :func:`read_archive` gives them, and the checked files.

    Every listed file is in the second table once: with an error, or with its
    lines in the first. A file that is damaged gives no line at all, so it can
    be read as a whole once it is mended.
    """
    files = stage(archive_files(spark, paths), "archive-files")
    # Names only, as many as Spark lists on the driver for any reader.
    good = [r.path for r in files.filter("error is null").select("path").toLocalIterator()]
    empty = spark.createDataFrame([], "value string")
    return (read_archive(spark, good) if good else _parsed(empty.withColumn("archive_hour", F.lit(None).cast("timestamp_ntz")))), files


def archive_errors(files: DataFrame) -> DataFrame:
    """The files of :func:`archive_files` that cannot be read, by name and hour."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter("error is not null").select(name.alias("file"), "archive_hour", "error")


def hour_range(bounds: DataFrame, start: Column | None, end: Column,
               hours_back: int = 1) -> DataFrame:
    """One row per hour in ``[start, end)`` for each row of ``bounds``.

    Both ends are cut to the hour; without a start it is ``end`` minus
    ``hours_back``.
    """
    last = hour_of(end)
    first = hour_of(start) if start is not None else last - F.make_dt_interval(hours=F.lit(hours_back))
    one = F.make_dt_interval(hours=F.lit(1))
    return (bounds.filter(first < last)
            .select(F.explode(F.sequence(first, last - one, one)).alias("hour")))


def in_hours(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Rows whose time lies in the hours ``[start, end)``."""
    return df.filter((F.col(ts) >= hour_of(start)) & (F.col(ts) < hour_of(end)))


def latest_hour(df: DataFrame, as_of: Column, look_back: int = 24, ts: str = "ts") -> DataFrame:
    """Newest hour present among the ``look_back`` hours before ``as_of``."""
    now = hour_of(as_of)
    recent = df.filter((F.col(ts) >= now - F.make_dt_interval(hours=F.lit(look_back))) & (F.col(ts) < now))
    return recent.agg(hour_of(F.max(ts)).alias("latest_hour"))
