"""Plans and stored files whose largest task, shuffles and readings follow the input."""

import pytest
from pyspark.sql import functions as F

from hushgate.catalog import queries as Q
from hushgate.catalog import views as v
from hushgate.operators import detect as D
from hushgate.plans import scan as N

KEY = "-----BEGIN RSA PRIVATE KEY-----\nRkFLRQ==\n-----END RSA PRIVATE KEY-----"


@pytest.fixture
def tables(spark, tmp_path):
    """Twelve events over four documents, of which two hold something."""
    events = spark.range(12).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-11 00:00:00' + make_dt_interval(0, id % 3)").alias("ts"),
        (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.format_string('{"k": %d}', "id").alias("props"))
    texts = ["plain\ntext", f"a\n{KEY}\nb", None, "token AKIA" + "ABCDEFGHIJKLMNOP"]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    events.write.parquet(f"{tmp_path}/events.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_diffs_are_not_shuffled_as_a_whole(spark, tables):
    diffs = v.diffs(spark, tables)
    assert "RepartitionByExpression" not in _plan(diffs)
    assert diffs.count() == v.push_keys(spark, tables).count()


def test_the_time_of_a_key_stays_with_its_diff(spark, tables):
    keys = v.push_keys(spark, tables).withColumn("ts", F.concat("sha", F.lit("!")))
    rows = v.diffs(spark, tables, keys.filter("k > 4")).collect()
    assert rows and {r.ts for r in rows} == {f"{r.sha}!" for r in rows}
    assert len(rows) == keys.filter("k > 4").count()


def test_diffs_are_read_once_for_all_detectors(spark, tables):
    plan = _plan(D.detect_in_diffs(v.diffs(spark, tables), "salt"))
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_only_diffs_that_hold_something_meet_their_keys(spark, tables):
    found = N.scan_diffs(v.diffs(spark, tables), "salt")
    assert "RLIKE" in _plan(found).split("Join ")[1]
    assert {r.detector for r in found.collect()} == {"private_key", "aws"}


def test_hours_of_diffs_are_dealt_once(spark, tables, monkeypatch):
    plans = []
    monkeypatch.setattr(Q.store, "write_by_hour", lambda df, path, **_: plans.append(_plan(df)))
    monkeypatch.setattr(Q.N, "scan_hours", lambda *a, **k: N.Scan(None, None))
    Q.scan_hours(spark, tables)
    # The outermost join attaches the texts, so that no later one moves them.
    assert plans[0].split("Join ")[1].startswith("Inner, (doc_id")


def test_diffs_of_the_streams_are_written_where_they_met_their_keys(spark, tables, monkeypatch):
    orders, files = {}, Q._files
    monkeypatch.setattr(Q, "_files", lambda df, name, *order: orders.update({name: order}) or files(df, name, *order))
    (_, _, diffs) = Q._stored_streams(spark, tables)
    assert orders["diffs"] == () and orders["events"] and orders["commits"]
    keys = v.push_keys(spark, tables).filter((F.col("user_id") + F.col("k")) % 7 != 0)
    rows = spark.read.parquet(diffs[0])
    assert rows.count() == keys.count() == rows.join(keys, ["repo", "sha"]).count() > 0


def test_one_time_of_many_rows_is_many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.lit("t").alias("stored_at"), F.col("id").cast("string").alias("repo"), F.lit("x").alias("sha"))
        path = Q._files(rows, "rows", "stored_at", "repo", "sha")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 4 and max(sizes) < 1000
