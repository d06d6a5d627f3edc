"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.sources import store

T = TypeVar("T")

#: Bytes of text that numpy works on at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


#: Rows of a batch that Python tasks of a staged step get; whole texts make rows large.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plan what runs inside with small Arrow batches: both sides of the pipe hold a few of them for each task."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same Arrow function, giving freed memory back to the machine after each batch and at the end.

    Python workers live on between tasks and steps; without this each keeps its
    largest moment for as long as it lives. What steps of other modules keep in
    the worker (:func:`kept_by`) goes as well.
    """
    module = run.__module__

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(module)
        for b in run(batches):
            yield b
            del b
            _give_back()
        _give_back()
    return tidied


def once_a_task(module: str, make: Callable[[], T]) -> Callable[[], T]:
    """What a function of single rows needs, made at its first row in a task; what steps of other modules keep goes then.

    Rows of a result that callers write themselves pass Python a hundred at a time this way. As Arrow batches, which
    only the session's settings bound, thousands of whole texts would stand on both sides of the pipe at once.
    """
    made: list[T] = []

    def get() -> T:
        if not made:
            _drop_others(module)
            made.append(make())
        return made[0]
    return get


_kept: dict[str, dict] = {}


def kept_by(module: str) -> dict:
    """What a module keeps in a Python worker from task to task, until a step of another module runs there."""
    return _kept.setdefault(module, {})


def _drop_others(module: str) -> None:
    others = _kept.keys() - {module}
    for other in others:
        del _kept[other]
    if others:
        gc.collect()
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that later steps read, and let Spark drop what made it.

    Spark deletes the shuffle files of a job once the driver has collected its
    plan as garbage. A driver with little else to do collects rarely, so long
    operators ask for it, or they would hold the shuffles of all their steps.
    """
    path = store.new_path(df.sparkSession, name)
    if (paths := getattr(_steps, "paths", None)) is not None:
        paths.append(path)
    with small_batches(df.sparkSession):
        out = store.written(df, path)
    df.sparkSession._jvm.System.gc()
    return out


#: Paths staged in this thread by the innermost :func:`stage_alone`.
_steps = threading.local()


def stage_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`stage` what ``make`` returns, and remove what this thread staged to make it.

    Staged tables else stay as long as the shared folder, those of finished steps too. Nothing but the result
    may be read afterwards.
    """
    around, made = getattr(_steps, "paths", None), []
    try:
        _steps.paths = made
        try:
            df = make()
        finally:
            _steps.paths = around
        return stage(df, name)
    finally:
        for path in made:
            store.remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    """Length in bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def empty_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, so that offsets and other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values of a string column, and where each value starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0]: at[-1]], at - at[0]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` so that numpy arrays stay small."""
    buf, at = text_buffer(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, buf[at[first]: at[end]], at[first: end + 1] - at[first]
        first = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Buckets of a key filter; the broadcast table has at most so many rows of one number.
FILTER_BUCKETS = 1 << 20


def only_buckets_of(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Drop rows of which no key in ``wanted`` shares the hash bucket, before a join on ``key`` shuffles them.

    The filter has a fixed size. Where every bucket is wanted it drops nothing
    and the join does all the work.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(FILTER_BUCKETS)).cast("int").alias("_bucket")
    some = wanted.select(bucket).distinct()
    return rows.withColumn("_bucket", bucket).join(F.broadcast(some), "_bucket", "left_semi").drop("_bucket")
