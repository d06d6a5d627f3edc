import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from hushgate.sources import archive, domains, findings, store

GOOD = {"id": "1", "type": "PushEvent", "created_at": "2024-01-01T05:00:01Z", "repo": {"name": "o/r"},
        "payload": {"head": "abc", "ref": "refs/heads/main", "extra": {"ignored": 1}}}


@pytest.fixture
def hour_file(tmp_path):
    path = tmp_path / "2024-01-01-5.json.gz"
    lines = [json.dumps(GOOD), "", '{"type": "PushEv', json.dumps({**GOOD, "id": "2", "payload": None}), "[]"]
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    return str(path)


def test_good_lines_stay_and_bad_lines_are_kept_apart(spark, hour_file):
    good = archive.read_archive_events(spark, hour_file).filter("id is not null")
    assert sorted(r.id for r in good.collect()) == ["1", "2"]
    assert {r.archive_hour for r in good.collect()} == {dt.datetime(2024, 1, 1, 5)}
    bad = [r.line for r in archive.corrupt_lines(spark, hour_file).collect()]
    assert '{"type": "PushEv' in bad and len(bad) <= 2


def test_hour_paths(spark):
    df = spark.createDataFrame([("/a/2024-01-02-3.json.gz",), ("/b/hour=2024-01-02-23/part-0.gz",), ("/c/other",),
                                ("2024-13-45-77.json.gz",)], "p string")
    got = [r.h for r in df.select(archive.hour_from_path(F.col("p")).alias("h")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 23), None, None]


def test_hour_range_is_empty_when_start_is_not_before_end(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7, 59), dt.datetime(2024, 1, 1, 7, 10))], "a timestamp_ntz, b timestamp_ntz")
    assert archive.hour_range(df, F.col("a"), F.col("b")).count() == 0
    assert [r.hour.hour for r in archive.hour_range(df, None, F.col("b"), 2).collect()] == [5, 6]


def test_latest_hour_looks_back_only_so_far(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3, 30),), (dt.datetime(2024, 1, 2, 9, 5),)], "ts timestamp_ntz")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert archive.latest_hour(df, at("2024-01-02 03:59:00")).first()[0] == dt.datetime(2024, 1, 1, 3)
    assert archive.latest_hour(df, at("2024-01-02 09:59:00")).first()[0] is None
    assert archive.latest_hour(df, at("2024-01-02 10:00:00")).first()[0] == dt.datetime(2024, 1, 2, 9)


def test_scanner_lines_in_all_shapes(spark):
    git = {"commit": "c1", "file": "f", "email": "e", "timestamp": "t", "repository": "r", "committer": "k"}
    base = {"DetectorName": "aws", "DetectorType": 2, "DecoderName": "PLAIN", "Verified": True}
    lines = [json.dumps({**base, "Redacted": "AK..", "Data": {"RawV2": "fakefakefake"}, "SourceMetadata": {"Data": {"Git": git}}}),
             json.dumps({**base, "Redacted": False, "RawV2": "fake2", "SourceMetadata": {"Data": {"git": git}}}),
             json.dumps({**base, "Redacted": True, "SourceMetadata": {"Git": git}}),
             json.dumps({**base, "SourceMetadata": {"git": git}}),
             json.dumps({**base, "Verified": "yes?", "SourceMetadata": {"Data": {"filesystem": {"file": "/x"}}}}),
             json.dumps({"SourceMetadata": {}}), "", "  ", "{broken", "12", '"text"']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = findings.parse_findings(df, "salt").collect()
    assert len(rows) == 6
    assert [r.commit for r in rows] == ["c1"] * 4 + ["", ""]
    assert [r.file for r in rows] == ["f"] * 4 + ["/x", ""]
    assert [r.redacted for r in rows] == [True, False, True, False, False, False]
    assert [r.verified for r in rows] == [True] * 4 + [False, False]
    assert rows[0].secret_redacted == "fak..." and "fakefake" not in str(rows)
    assert rows[0].detector_type == "2"


def test_empty_domain_list_keeps_the_stored_one(spark, tmp_path):
    path = str(tmp_path / "list")
    some = spark.createDataFrame([("b.com",), ("a.com",), ("b.com",)], "domain string")
    assert domains.write_domain_list(some, path, "test")
    assert not domains.write_domain_list(some.limit(0), path, "test")
    assert sorted(r.domain for r in domains.read_domain_list(spark, path).collect()) == ["a.com", "b.com"]


def test_domain_document_and_extraction(spark, tmp_path):
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"source": "s", "count": 2, "domains": ["x.com", "y.co.uk"]}, indent=2))
    assert domains.read_domain_document(spark, str(doc)).count() == 2
    text = spark.createDataFrame([("Domain,Name\nacme.com,Acme\r\nme@GMAIL.com; sub.shop.co.uk\n",)], "text string")
    assert [r.domain for r in domains.extract_domains(text).collect()] == ["acme.com", "sub.shop.co"]


def test_hour_partitions_prune_and_split_a_busy_hour(spark, tmp_path):
    df = spark.range(4000).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, if(id % 3 = 0, id % 4, 9))").alias("ts"))
    path = str(tmp_path / "h")
    store.write_by_hour(df, path, files_per_hour=4)
    busy = list((tmp_path / "h" / "hour=2024-01-01-09").glob("*.parquet"))
    assert len(busy) > 1 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    part = store.read_by_hour(spark, path, "2024-01-01-09", "2024-01-01-10")
    assert part.count() == df.filter("hour(ts) = 9").count()
    assert len(part.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(hour" in part._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark):
    from hushgate.operators.resolve import attach_diffs
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(100).select(F.concat(F.lit("o/r"), "id").alias("repo"), F.col("id").cast("string").alias("sha"))
        store.write_bucketed(a.withColumn("diff", F.lit("d")), "bucketed_diffs", ["repo", "sha"], 4)
        store.write_bucketed(a, "bucketed_suspicious", ["repo", "sha"], 4)
        joined = attach_diffs(spark.table("bucketed_suspicious"), spark.table("bucketed_diffs"))
        assert joined.count() == 100
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS bucketed_diffs")
        spark.sql("DROP TABLE IF EXISTS bucketed_suspicious")


def test_second_write_keeps_other_hours_and_staging_cleans_up(spark, tmp_path):
    from hushgate.sources.store import read_by_hour, stage, staging, write_by_hour

    rows = lambda h, n: spark.createDataFrame([(i, f"2024-01-01 {h}:00:00") for i in range(n)], "i int, t string").selectExpr(
        "i", "cast(t AS timestamp_ntz) AS ts")
    path = str(tmp_path / "hours")
    write_by_hour(rows("03", 10), path)
    write_by_hour(rows("04", 1), path)
    write_by_hour(rows("04", 2), path)
    assert read_by_hour(spark, path).count() == 12
    with staging(spark, str(tmp_path / "staged")) as folder:
        assert stage(rows("05", 7), "x").count() == 7 and folder.startswith(str(tmp_path))
        assert any((tmp_path / "staged").iterdir())
    assert not any((tmp_path / "staged").iterdir())


def test_gzip_faults_of_every_cut():
    """A file is readable only as a whole, also of several members; no cut of it is taken for whole."""
    import gzip
    import os

    one, two = gzip.compress(b"line\n" * 3000 + os.urandom(3_000_000)), gzip.compress(b"more\n")
    assert archive.gzip_fault(memoryview(one)) is None and archive.gzip_fault(memoryview(one + two)) is None
    for cut in (1, 5, 17, 2000, len(one) - 9, len(one) - 1, len(one) + 1, len(one) + len(two) - 1):
        assert archive.gzip_fault(memoryview((one + two)[:cut])) in ("truncated", "damaged")
    wrong = bytearray(one)
    wrong[len(one) // 2] ^= 255
    assert archive.gzip_fault(memoryview(bytes(wrong))) == "damaged"
    assert archive.gzip_fault(memoryview(one + b"rest")) == "damaged"
    assert archive.gzip_fault(memoryview(b"")) == "empty" and archive.gzip_fault(memoryview(b"{}\n")) == "not gzip"


def test_one_damaged_hour_does_not_end_the_run(spark, tmp_path):
    import gzip

    line = b'{"id": "%d", "type": "PushEvent", "repo": {"name": "o/r"}}\n'
    for hour in range(3):
        data = gzip.compress(b"".join(line % i for i in range(hour * 2000, hour * 2000 + 2000)))
        (tmp_path / f"2024-01-01-{hour}.json.gz").write_bytes(data[: len(data) // 2] if hour == 1 else data)
    (tmp_path / "2024-01-01-3.json").write_bytes(line % 9000 + b'{"type": "Pu\n')
    rows, files = archive.read_archive_safely(spark, str(tmp_path))
    assert files.count() == 4
    assert [(r.file, r.archive_hour.hour, r.error) for r in archive.archive_errors(files).collect()] == [("2024-01-01-1.json.gz", 1, "truncated")]
    good = rows.filter(f"{archive.CORRUPT} is null").groupBy("archive_hour").count().collect()
    assert sorted((r.archive_hour.hour, r["count"]) for r in good) == [(0, 2000), (2, 2000), (3, 1)]
    assert rows.filter(f"{archive.CORRUPT} is not null").count() == 1
    rows, files = archive.read_archive_safely(spark, str(tmp_path / "2024-01-01-1.json.gz"))
    assert rows.count() == 0 and files.count() == 1
