import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hushgate.operators.classify import classify, classifier_stats, suspicious_only
from hushgate.operators.summary import first_errors, run_summary
from hushgate.plans import report as P
from hushgate.schemas import FINDING_COLUMNS
from hushgate.sources.store import new_path
from hushgate.streaming import monitor

FAKE_KEY = "sk-" + "Fake1" * 6


@pytest.fixture
def run(spark):
    commits = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 1), "o/r", "a" * 40, f"remove key {FAKE_KEY} from code"),
         (2, dt.datetime(2024, 1, 1, 2), "o/r", "b" * 40, "docs")],
        "event_id long, ts timestamp_ntz, repo string, sha string, message string")
    classified = classify(commits)
    row = dict.fromkeys(FINDING_COLUMNS, "")
    rows = [{**row, "detector": d, "verified": v, "redacted": True, "commit": "c" * 40, "repository": "o/r", "secret_fp": str(i)}
            for i, (d, v) in enumerate([("aws", True), ("aws", True), ("gcp", True), ("gcp", None)])]
    schema = ", ".join(f"{c} {'boolean' if c in ('verified', 'redacted') else 'string'}" for c in FINDING_COLUMNS)
    return classified, spark.createDataFrame(rows, schema)


def test_reports_show_counts_but_no_secret(spark, run, tmp_path):
    classified, found = run
    errors = spark.createDataFrame([(f"bad line {FAKE_KEY}",)], "line string")
    summary, suspicious, stats = run_summary(classified, found), suspicious_only(classified), classifier_stats(classified)
    markdown = [r.line for r in P.report_markdown(summary, found, suspicious).collect()]
    text = [r.line for r in P.report_text(summary, found, stats, errors).collect()]
    body = P.report_json(summary, found, suspicious, stats, errors)
    json_lines = [r.body for r in body.collect()]
    assert "| aws | 2 |" in markdown and "| gcp | 1 |" in markdown and "**Verified secrets found:** 3" in markdown
    assert markdown.index("| aws | 2 |") < markdown.index("| gcp | 1 |")
    assert "    aws: 2" in text and "  Errors (1):" in text and text[0] == text[-1] == P.RULE
    assert not [x for x in markdown + text + json_lines if FAKE_KEY in x]
    assert [x for x in json_lines if "remove key *** from code" in x]
    P.write_report_json(body, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == len(json_lines)
    P.write_report_lines(P.report_markdown(summary, found, suspicious), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == markdown


def test_report_of_nothing_has_no_listings(run):
    classified, found = run
    none, nobody = found.limit(0), classified.limit(0)
    lines = [r.line for r in P.report_markdown(run_summary(nobody, none), none, nobody).collect()]
    assert lines[0] == "# Secret Scan Report" and not [x for x in lines if x.startswith("##")]


def test_long_listings_number_their_lines_over_all_ranges(spark):
    names = [(f"d{i * 7919 % 3000:04d}", i % 4) for i in range(3000)]
    df = spark.createDataFrame(names, "detector string, findings int").repartition(8)
    with_ranges = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in with_ranges}
    for k, v in with_ranges.items():
        spark.conf.set(k, v)
    try:
        rows = P._long_listing(df, 2, F.col("detector"), F.desc("findings"), "detector").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [r.line for r in sorted(rows, key=lambda r: r.pos)]
    assert got == [d for d, _ in sorted(names, key=lambda x: (-x[1], x[0]))]
    assert sorted(r.pos for r in rows) == list(range(3000)) and {r.section for r in rows} == {2}


def test_first_errors_without_errors(spark):
    assert first_errors(spark.createDataFrame([], "line string")).count() == 0


EVENT = "event_id long, ts timestamp_ntz, repo string, sha string, kind string"


def _row(i, hour, sha="s"):
    return i, dt.datetime(2024, 1, 1, hour, 30), "o/r", sha, "PushEvent"


def test_stream_dedup_and_late_rows_across_restarts(spark):
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    batches = [[_row(1, 10, "x"), _row(2, 10, "x"), _row(3, 10, "y")], [_row(4, 11, "x"), _row(5, 11, "z")],
               [_row(6, 20, "w")], [_row(7, 10, "late")]]
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
        stream = monitor.monitor_dedup(spark.readStream.schema(EVENT).parquet(folder))
        monitor.start_to_parquet(stream.select("repo", "sha"), out, state).awaitTermination()
    assert sorted(r.sha for r in spark.read.parquet(out).collect()) == ["w", "x", "y", "z"]


def test_alerts_are_written_once_per_batch(spark, run):
    _, found = run
    folder, out, state = (new_path(spark, n) for n in ("f", "alerts", "state"))
    for part in (found, found.filter("verified is null")):
        part.coalesce(1).write.mode("append").parquet(folder)
        monitor.alert_stream(spark.readStream.schema(found.schema).parquet(folder), out, state).awaitTermination()
    alerts = spark.read.parquet(out)
    assert alerts.count() == 3 and alerts.select("batch").distinct().count() == 1


def test_archive_stream_skips_broken_lines(spark, tmp_path):
    (tmp_path / "2024-01-01-0.json").write_text('{"id": "1", "type": "PushEvent", "repo": {"name": "o/r"}}\n{"type": "Pu\n\n')
    rows = monitor.run_once(spark, monitor.read_archive_stream(spark, str(tmp_path)).select("id", "type"), "archive")
    assert [tuple(r) for r in rows.collect()] == [("1", "PushEvent")]


def test_monitor_loses_no_push_diff_or_line(spark, tmp_path):
    def push(n, repo="o/r"):
        return json.dumps({"id": str(n), "type": "PushEvent", "created_at": "2024-01-01T01:00:00Z", "repo": {"name": repo},
                           "payload": {"head": f"s{n}", "ref": "refs/heads/main"}})

    table = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    commits = lambda *ns: table("commits", [("o/r", f"s{n}", f"remove leaked api key {FAKE_KEY}") for n in ns], "repo string, sha string, message string")
    diffs = lambda *ns: table("diffs", [("o/r", f"s{n}", f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-k = {FAKE_KEY}{n}\n") for n in ns],
                              "repo string, sha string, diff string")
    names = spark.createDataFrame([("O",)], "handle string"), spark.createDataFrame([("none.example",)], "domain string")

    def turn(hour, *lines):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"2024-01-01-{hour}.json").write_text("\n".join(lines) + "\n")
        read = lambda name: spark.read.parquet(str(tmp_path / name))
        known = read("out/findings").select("secret_fp").filter(F.lit(hour == 3)) if hour else None
        known = known.withColumn("verified", F.lit(True)).localCheckpoint() if known is not None else None
        monitor.run_monitor(monitor.read_archive_lines(spark, str(tmp_path / "in")), read("commits"), read("diffs"), "salt", str(tmp_path / "out"),
                            str(tmp_path / "state"), owned=names, verified=known).awaitTermination()

    def shas(name, batch):
        return sorted(r.sha for r in spark.read.parquet(str(tmp_path / "out" / name / f"batch={batch}")).collect())

    commits(1, 4)
    diffs(1)
    turn(0, push(1), push(2), push(4), push(1), push(9, "else/r"), '{"type": "Pu', "", '{"id": "5"}')
    assert shas("unresolved", 0) == ["s2"] and shas("without_diff", 0) == ["s4"] and shas("findings", 0) == ["s1"]
    broken = spark.read.parquet(str(tmp_path / "out/broken")).collect()
    assert sorted(r.line for r in broken) == ['{"id": "5"}', '{"type": "Pu']
    turn(1, push(1))
    assert shas("unresolved", 1) == ["s2"] and shas("without_diff", 1) == ["s4"] and shas("findings", 1) == []
    commits(2)
    diffs(2, 4)
    turn(2, push(3))
    assert shas("unresolved", 2) == ["s3"] and shas("without_diff", 2) == [] and shas("findings", 2) == ["s2", "s4"]
    assert not (tmp_path / "out/alerts").exists()
    commits(3)
    table("diffs", [("o/r", "s3", f"diff --git a/x b/x\n@@ -1 +1 @@\n+k = {FAKE_KEY}1\n")], "repo string, sha string, diff string")
    turn(3, push(2))
    assert shas("unresolved", 3) == [] and shas("suspicious", 3) == ["s2", "s3"] and shas("findings", 3) == shas("alerts", 3) == ["s3"]
    assert not [r for name in ("suspicious", "findings") for r in spark.read.parquet(str(tmp_path / "out" / name)).collect() if FAKE_KEY in str(r)]
