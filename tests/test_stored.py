"""What is stored for later runs: versioned lists, sketches, hours, review batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hushgate import schemas
from hushgate.operators import review as W
from hushgate.operators import summary as M
from hushgate.plans import scan as N
from hushgate.sources import domains, store


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "domain string")


def test_a_write_that_fails_leaves_the_old_list_whole(spark, monkeypatch):
    path = store.new_path(spark, "list")
    read = lambda: sorted(r.domain for r in domains.read_domain_list(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        read()
    assert domains.write_domain_list(named(spark, "a.example", "b.example"), path, "x") and read() == ["a.example", "b.example"]
    assert not domains.write_domain_list(named(spark).filter("false"), path, "x") and read() == ["a.example", "b.example"]
    with monkeypatch.context() as m:
        m.setattr(domains, "write_bytes", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            domains.write_domain_list(named(spark, "c.example"), path, "x")
    assert read() == ["a.example", "b.example"] and domains.read_domain_summary(spark, path).first()["count"] == 2
    for n in "defgh":
        domains.write_domain_list(named(spark, f"{n}.example"), path, "y")
    assert read() == ["h.example"] and len(domains.versions(spark, path)) == domains.KEPT_VERSIONS
    assert domains.read_domain_summary(spark, path).first().source == "y"


def test_merged_sketches_count_a_value_of_many_parts_once(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("hour"), (F.col("id") % 2 == 0).alias("verified"), F.concat(F.lit("f"), (F.col("id") % 9000).cast("string")).alias("file"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.lit("one@x.example")).alias("email"), F.lit(None).cast("string").alias("repository"))
    path = store.new_path(spark, "sketches")
    for hours in ("hour < 3", "hour >= 3"):
        M.distinct_sketches(rows.filter(hours), "hour").write.mode("append").parquet(path)
    got = M.merge_sketches(spark.read.parquet(path)).first()
    assert (got.total_findings, got.verified_count, got.unique_emails, got.unique_repos) == (60_000, 30_000, 1, 0)
    assert abs(got.unique_files - 9000) < 9000 * 0.03
    assert M.merge_sketches(spark.read.parquet(path), "hour").count() == 7


def test_batches_are_full_but_for_the_last(spark):
    keys = spark.range(1234).select(F.concat(F.lit("message "), (F.col("id") % 1000).cast("string")).alias("message_key")).repartition(5)
    rows = W.number_in_full_batches(keys, size=30, per_bucket=64).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(int(r.batch_id), []).append(r.idx)
    assert len({r.message_key for r in rows}) == len(rows) == 1000
    assert sorted(sizes) == list(range(34)) and all(sorted(v) == list(range(30 if k < 33 else 10)) for k, v in sizes.items())
    assert W.number_in_full_batches(keys.filter("false")).count() == 0
    again = W.number_in_full_batches(keys.repartition(3), size=30, per_bucket=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_an_hour_range_reads_its_hours_of_diffs_only(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    diff = f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-k = {key}\n"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    pushes = [(h, f"s{h}") for h in (1, 30, 31, 60)]
    raw = spark.createDataFrame([(str(h), "PushEvent", at(h).strftime("%Y-%m-%dT%H:%M:%SZ"), ("o/r",), (s, None, None, None, None)) for h, s in pushes], schemas.RAW_EVENT)
    commits = spark.createDataFrame([("o/r", s, "remove leaked api key") for _, s in pushes], "repo string, sha string, message string")
    path = store.new_path(spark, "diffs")
    # The diff of one commit was stored a few hours before its push, that of another long before.
    stored = [("o/r", "s30", diff, at(28)), ("o/r", "s31", diff, at(2)), ("o/r", "s1", diff, at(1)), ("o/r", "s60", diff, at(60))]
    store.write_by_hour(spark.createDataFrame(stored, "repo string, sha string, diff string, ts timestamp_ntz"), path)
    run = N.scan_hours(raw, commits, path, "salt", "2024-01-02-00", "2024-01-03-00", look_back=12)
    assert [r.sha for r in run.findings.collect()] == ["s30"] and run.classified.count() == 2
    plan = run.findings._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and "2024-01-01-12" in plan
