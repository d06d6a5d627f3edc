"""Continuous monitoring as Structured Streaming queries.

A source folder of event files takes the place of polling; the query checkpoint
remembers what was processed, so a restart neither repeats nor skips an hour.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushgate.functions.secrets import redact_text
from hushgate.operators.attribute import Owned, attribute_events
from hushgate.operators.classify import classify, classify_batch, suspicious_only
from hushgate.operators.resolve import KEYS, attach_diffs, resolve_messages, unresolved_pushes
from hushgate.plans.scan import commit_events, scan_diffs
from hushgate.schemas import CORRUPT_COLUMN, RAW_EVENT, RAW_EVENT_WITH_CORRUPT
from hushgate.sources.store import new_path

DELAY = "2 hours"

#: State lies on disk, in one store for each partition of a join, and all stores of an executor share one
#: bound on what they hold in memory. (``unloadOnCommit`` leaves the stores of joins open for good.)
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Else each open store reserves 4 MB of disk for its manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def read_archive_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A broken line parses to nulls and has no type.
    return reader.json(path).filter(F.col("type").isNotNull())


def read_archive_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Every line but blank ones: parsed events, and lines that are no events as redacted text in the corrupt column."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    event = F.from_json("value", RAW_EVENT_WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN})
    bad = F.col(f"e.{CORRUPT_COLUMN}").isNotNull() | F.col("e.type").isNull()
    return (reader.text(path).filter(F.trim("value") != "").select("value", event.alias("e"))
            .select(*[f"e.{f.name}" for f in RAW_EVENT.fields],
                    F.when(bad, redact_text(F.col("value"))).alias(CORRUPT_COLUMN)))


def _event_time(df: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def monitor_stream(raw: DataFrame, commits: DataFrame, owned: tuple[Owned, Owned] | None = None) -> DataFrame:
    """Suspicious commits of a stream of raw events: the classifying part of :func:`run_monitor`.

    ``commits`` is a table; Spark reads its current content in every batch. A push
    whose commit is stored after its batch is left out; ``run_monitor`` keeps it.
    """
    return suspicious_only(classify(resolve_messages(commit_events(raw, owned), commits)))


def monitor_dedup(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each ``(repo, sha)`` once within the delay.

    State is kept per key only until the watermark passes it, and late rows
    beyond the watermark are dropped.
    """
    return _event_time(events, delay=delay).dropDuplicatesWithinWatermark(["repo", "sha"])


def monitor_attribution(raw: DataFrame, orgs: Owned, domains: Owned) -> DataFrame:
    """Attribution inside the stream, without state: owned names are compiled in or joined as tables."""
    return attribute_events(raw, orgs, domains)


def hourly_window_counts(events: DataFrame, kind: str = "kind", ts: str = "ts",
                         delay: str = DELAY) -> DataFrame:
    """Events per hour and kind, emitted once an hour is closed by the watermark."""
    return (_event_time(events, ts, delay)
            .groupBy(F.window(ts, "1 hour"), kind)
            .agg(F.count("*").alias("events"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("hour"), kind, "events"))


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state by :data:`STATE_CONF`, but for what the session sets itself.

    Spark's own default holds all state, and that of the batch before, in the heaps of the
    executors. A query that goes on from a checkpoint keeps the stores with which it began.
    """
    unset = [k for k in STATE_CONF if spark.conf.get(k, None) is None]
    for key in unset:
        spark.conf.set(key, STATE_CONF[key])
    try:
        yield
    finally:
        for key in unset:
            spark.conf.unset(key)


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None,
                     mode: str = "append") -> StreamingQuery:
    """Run a stream into Parquet, for ever with an interval or once over what is there."""
    writer = (stream.writeStream.format("parquet").outputMode(mode)
              .option("path", path).option("checkpointLocation", checkpoint))
    return _trigger(writer, interval).start()


def alert_stream(findings: DataFrame, path: str, checkpoint: str,
                 interval: str | None = None) -> StreamingQuery:
    """Write the verified findings of each batch, and nothing for a batch without any.

    Each batch owns one folder, so a batch that is run again replaces its output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        verified = batch.filter("verified").persist()
        try:
            if not verified.isEmpty():
                verified.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            verified.unpersist()

    writer = findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def run_monitor(raw: DataFrame, commits: DataFrame, diffs: DataFrame, salt: str, path: str, checkpoint: str, *,
                owned: tuple[Owned, Owned] | None = None, scorer: str | None = None,
                verified: DataFrame | None = None, interval: str | None = None) -> StreamingQuery:
    """Raw events to findings and alerts, batch by batch, each output in ``path/<name>/batch=<number>``.

    - ``broken``: lines that are no events, if ``raw`` is of :func:`read_archive_lines`;
    - ``unresolved``: pushes whose commit is not stored yet; every later batch looks again;
    - ``suspicious``: suspicious commits, secrets in their messages masked;
    - ``without_diff``: keys of suspicious commits whose diff is not stored yet; looked for again likewise;
    - ``scanned``: keys whose diff was scanned; a commit is scanned once, in whatever batch it comes again;
    - ``findings``: findings in those diffs, ``verified`` where the table ``verified(secret_fp, verified)`` knows them;
    - ``alerts``: the verified ones, no folder for a batch without any.

    ``unresolved`` and ``without_diff`` of the newest batch are what is open; nothing
    gives up on them. Looking again takes a batch, thus new events. Tables are read
    anew in each batch, so ``owned`` may be tables as well. A batch that is run
    again replaces its output; ``path`` and ``checkpoint`` belong together.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, name: str) -> DataFrame:
            """What a batch decides is read from what it wrote: the tables may grow meanwhile."""
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}/batch={number}")

        def earlier(schema, name: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}/batch={number - 1}")

        def missing(wanted: DataFrame, those: DataFrame) -> DataFrame:
            return wanted.join(those.select(*KEYS).distinct(), KEYS, "left_anti")

        batch = batch.persist()
        try:
            events = batch
            if CORRUPT_COLUMN in batch.columns:
                put(batch.filter(F.col(CORRUPT_COLUMN).isNotNull()).select(F.col(CORRUPT_COLUMN).alias("line")), "broken")
                events = batch.filter(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)
            keyed = commit_events(events, owned)
            if number:
                keyed = keyed.unionByName(earlier(keyed.schema, "unresolved"))
            unresolved = put(unresolved_pushes(keyed, commits), "unresolved")
            ready = missing(keyed.filter(~F.col("is_pr")), unresolved).unionByName(keyed.filter("is_pr"))
            found = suspicious_only(classify_batch(resolve_messages(ready, commits), scorer=scorer))
            suspicious = put(found.withColumn("message", redact_text(F.col("message"))), "suspicious")

            wanted = suspicious.filter(~F.col("is_pr")).select(*KEYS)
            if number:
                done = spark.read.schema("repo string, sha string, batch int").parquet(f"{path}/scanned")
                wanted = missing(wanted.unionByName(earlier(wanted.schema, "without_diff")), done.filter(F.col("batch") < number))
            wanted = wanted.distinct()
            without = put(missing(wanted, diffs), "without_diff")
            now = put(missing(wanted, without), "scanned")
            findings = scan_diffs(attach_diffs(now, diffs), salt)
            known = (verified.groupBy("secret_fp").agg(F.bool_or("verified").alias("verified")) if verified is not None
                     else spark.createDataFrame([], "secret_fp string, verified boolean"))
            alerts = put(findings.join(known, "secret_fp", "left"), "findings").filter("verified")
            if not alerts.isEmpty():
                put(alerts, "alerts")
        finally:
            batch.unpersist()

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available now and read the result as a table."""
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    start_to_parquet(stream, path, checkpoint, mode=mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
