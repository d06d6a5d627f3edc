"""WARC archives in which repeated payloads are revisit records.

Headers alone are grouped by payload digest; the record with the smallest key
in a group of equal payloads stays a response and the others point at it.
Revisits are made of headers and responses of the table itself: payloads that
nothing repeats are not shuffled.
Archives are written by Spark's text writer, whose line separator is the end
mark of a record, so no task opens a file by itself.

Defined results: null payload is empty; null address has no target line; null
key is never chosen while another key exists; rows that repeat the chosen key
are responses too; an empty table gives an empty archive; other columns
are ignored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.llm.common import FILTER_BUCKETS, empty_text, only_buckets_of, sha256_hex, stage, utf8_bytes

#: Payloads below this many bytes are always written in full.
LEAST_REVISIT_BYTES = 100
#: Aim for the size of one archive file, which one task reads whole.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, url string, record_type string, refers_id string, refers_to long, " \
         "payload_digest string, payload string"


def resolve_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                     least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Key, address and payload with ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to``.

    The least key per digest is an aggregate over staged headers, so equal
    payloads combine before the shuffle. Revisits come out of the headers, with
    a null payload. Rows of short payloads, or whose payload is in a hash bucket
    without repeats, are responses where they lie; only of the others are payloads
    shuffled, by key and digest, and by then most copies are dropped.
    """
    bucket = F.pmod("_hash", F.lit(FILTER_BUCKETS)).cast("int")
    rows = (pages.select(key, url, empty_text(F.col(payload)).alias(payload))
            .withColumns({"payload_bytes": utf8_bytes(F.col(payload)), "_hash": F.xxhash64(payload)})
            .withColumn("_bucket", bucket))
    digest = {"payload_digest": sha256_hex(F.col(payload))}
    long = F.col("payload_bytes") >= least_bytes
    heads = stage(rows.filter(long).withColumns(digest).drop(payload), "warc-headers")
    first = (heads.groupBy("payload_digest").agg(F.min(key).alias("_first"), F.min("_bucket").alias("_bucket"), F.count("*").alias("_n"))
             .filter("_n > 1 AND _first IS NOT NULL"))
    # At most FILTER_BUCKETS rows of one number.
    repeats = F.broadcast(first.select("_bucket").distinct().withColumn("_repeats", F.lit(True)))
    revisits = (heads.join(first.select("payload_digest", "_first"), "payload_digest").filter(~F.col(key).eqNullSafe(F.col("_first")))
                .select(key, url, F.lit(None).cast("string").alias(payload), "payload_digest", "payload_bytes",
                        F.lit("revisit").alias("record_type"), F.col("_first").alias("refers_to")))
    named = F.xxhash64(key, "_hash")
    kept = (heads.join(repeats, "_bucket").join(first.select("payload_digest", "_first"), "payload_digest", "left")
            .filter(F.col("_first").isNull() | (F.col(key) == F.col("_first")))
            .select(F.col(key).alias("_key"), F.col("payload_digest").alias("_digest"), named.alias("_name")))
    marked = rows.join(repeats, "_bucket", "left")
    asks = F.coalesce(F.col("_repeats") & long, F.lit(False))
    asked = only_buckets_of(marked.filter(asks).withColumn("_name", named).drop("_bucket"), kept, "_name").withColumns(digest)
    same = (F.col("payload_digest") == F.col("_digest")) & F.col(key).eqNullSafe(F.col("_key"))
    responses = (marked.filter(~asks).withColumns(digest)
                 .unionByName(asked.join(kept.drop("_name"), same, "left_semi"), allowMissingColumns=True)
                 .select(key, url, payload, "payload_digest", "payload_bytes", F.lit("response").alias("record_type"),
                         F.lit(None).cast(pages.schema[key].dataType).alias("refers_to")))
    return responses.unionByName(revisits)


def _record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.encode(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), digest), "UTF-8"))
    return F.concat(*[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                      for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; control characters cannot end a line early."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(resolved: DataFrame, path: str, date: str, key: str = "page_id", url: str = "url",
                  payload: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write records with fresh headers under ``path``; ``date`` is the WARC-Date of all of them.

    Files keep the partitioning of the records; how many a file holds follows from their mean size.
    """
    k, digest, revisit = F.col(key), F.col("payload_digest"), F.col("record_type") == "revisit"
    size = F.when(revisit, 400).otherwise(F.col("payload_bytes") + 600)
    total, rows = resolved.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP_HEAD), F.col(payload)))
    refers = F.when(revisit, _record_id(F.col("refers_to"), digest))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _record_id(k, digest), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col(url)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), refers, F.lit(">"))),
        _line("X-Key", k), _line("X-Refers-To-Key", F.when(revisit, F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(body)), F.lit("\r\n"), body)
    (resolved.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, rows * file_bytes // max(total, 1))).text(path))


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers by lower-case name and the block of each record."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        head = {n.strip().lower(): v.strip() for n, _, v in
                (x.partition(":") for x in m[1].decode("utf-8").split("\r\n") if x)}
        end = m.end() + int(head["content-length"])
        if data[end:end + 4] != END.encode():
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield head, data[m.end():end]
        at = end + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to") else pa.large_string()) for n in names])
    number = lambda s: None if s is None else int(s)
    uuid = lambda s: s and s.removeprefix("<urn:uuid:").removesuffix(">")
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in parse_records(gzip.decompress(content.as_py())):
                payload = block.split(END.encode(), 1)[1].decode("utf-8") if h["warc-type"] == "response" else None
                rows.append((uuid(h["warc-record-id"]), number(h.get("x-key")), h.get("warc-target-uri"),
                             h["warc-type"], uuid(h.get("warc-refers-to")), number(h.get("x-refers-to-key")),
                             h["warc-payload-digest"].removeprefix("sha256:"), payload))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``; a revisit has no payload of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, RECORD)


def with_payload_size(records: DataFrame) -> DataFrame:
    """Join revisits to the responses they point at; ``payload_bytes`` is that of the full payload.

    Only record ids and sizes are shuffled, not payloads.
    """
    rows = records.withColumn("_own", F.octet_length("payload").cast("long")).drop("payload")
    heads = (rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id"))
             .agg(F.max("_own").alias("_full")))
    return (rows.join(heads, "refers_id", "left")
            .withColumn("payload_bytes", F.coalesce("_own", "_full")).drop("_own", "_full"))
