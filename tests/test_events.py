import datetime as dt

import pytest
from pyspark.sql import functions as F

from hushgate.functions import forge as G
from hushgate.functions import text as T
from hushgate.operators import attribute as A
from hushgate.operators import events as E
from hushgate.operators import resolve as R
from hushgate.operators import summary as M
from hushgate.schemas import RAW_EVENT


def push(i, repo, head="h", mails=()):
    commits = [{"author": {"email": a}, "committer": {"email": c}} for a, c in mails]
    return {"id": str(i), "type": "PushEvent", "created_at": "2024-01-01T00:00:01Z", "repo": {"name": repo},
            "payload": {"head": head, "commits": commits}}


def pr(i, action, title, number=5):
    return {"id": str(i), "type": "PullRequestEvent", "created_at": "2024-01-01T00:10:00Z", "repo": {"name": "o/r"},
            "payload": {"action": action, "pull_request": {"title": title, "number": number}}}


@pytest.fixture
def raw(spark):
    rows = [push(1, "Acme/a", mails=[("x@y.com", "y@y.com")]), push(2, "o/a", mails=[("a@b@MINE.example ", None), (None, "z@own.example")]),
            push(3, "o/b", mails=[("nobody", "q@own.example"), ("m@mine.example", "")]), push(4, "solo", mails=[("m@mine.example", "")]),
            push(5, "a/b/c"), push(6, "o/d", head=""), push(7, "o/e", mails=[]), push(8, None), pr(9, "opened", "fix key"),
            pr(10, "closed", "x"), pr(11, "reopened", ""), {"id": "12", "type": "WatchEvent", "repo": {"name": "acme/z"}, "payload": None}]
    return spark.createDataFrame(rows, RAW_EVENT)


def test_commit_keys(raw):
    rows = {r.event_id: r for r in E.commit_key(E.union_events(E.push_events(raw), E.pr_events(raw))).collect()}
    assert set(rows) == {1, 2, 3, 7, 9}
    assert rows[9].sha == "pr-5" and rows[9].message == "fix key" and rows[9].is_pr
    assert rows[1].sha == "h" and rows[1].message is None and rows[1].ts == dt.datetime(2024, 1, 1, 0, 0, 1)


def test_times_do_not_depend_on_the_session_zone(spark, strings):
    times = strings(["2024-07-01T23:30:05Z", "2024-07-01T16:30:05-07:00", "soon", None])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        got = [r.t for r in times.select("i", E.utc_time(F.col("text")).alias("t")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [dt.datetime(2024, 7, 1, 23, 30, 5)] * 2 + [None, None]


@pytest.mark.parametrize("as_table", [True, False])
def test_attribution(spark, raw, as_table):
    orgs, mails = ["ACME"], ["mine.example", "own.example"]
    if as_table:
        orgs = spark.createDataFrame([(o,) for o in orgs], "handle string")
        mails = spark.createDataFrame([(m,) for m in mails], "domain string")
    rows = {r.id: r for r in A.attribute_events(raw, orgs, mails).collect()}
    assert len(rows) == 12
    assert (rows["1"].label, rows["1"].matched_via, rows["1"].matched_value) == ("Org: Acme", "org_handle", "Acme")
    assert (rows["2"].label, rows["2"].matched_via) == ("Domain: mine.example", "author_domain")
    assert (rows["3"].label, rows["3"].matched_via) == ("Domain: own.example", "committer_domain")
    assert rows["4"].label == "unknown" and not rows["4"].is_owned
    assert rows["7"].label == "general-stream" and rows["12"].label == "Org: acme"
    attributed = A.attribute_events(raw, orgs, mails)
    assert A.owned_only(attributed).count() + A.not_owned(attributed).count() == 12
    hits = {r.event_id: r.matched_value for r in A.attribute_by_email(raw, mails).collect()}
    assert hits == {2: "mine.example", 3: "own.example", 4: "mine.example"}


def test_resolving_a_commit_pushed_by_most_events(spark):
    pushes = spark.range(3000).select(
        F.col("id").alias("event_id"), F.lit("o/r").alias("repo"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("sha"),
        F.lit(None).cast("string").alias("message"), F.lit(False).alias("is_pr"))
    commits = spark.createDataFrame([("o/r", "hot", "remove key\nbody"), ("o/r", "s0", ""), ("o/r", "s3", "m")],
                                    "repo string, sha string, message string")
    out = R.resolve_messages(pushes, commits)
    assert out.filter("sha = 'hot' and message = 'remove key'").count() == 2000 and out.count() == 2001
    assert R.unresolved_pushes(pushes, commits).count() == 999
    firsts = E.distinct_commits(pushes)
    assert firsts.count() == 1001 and firsts.filter("sha = 'hot'").first().event_id == 1
    seen = E.first_seen(pushes, "sha")
    assert seen.count() == 3000 and seen.filter("not cache_hit").count() == 1001
    assert "Window" not in seen._jdf.queryExecution().executedPlan().toString()


def test_sample_keeps_or_drops_a_commit_everywhere(spark):
    df = spark.range(2000).select(F.lit("o/r").alias("repo"), (F.col("id") % 500).cast("string").alias("sha"))
    kept = E.sample_commits(df, 0.5).groupBy("sha").count()
    assert kept.filter("count <> 4").count() == 0 and 150 < kept.count() < 350
    assert E.sample_commits(df, 1.0).count() == 2000 and E.sample_commits(df, 0.0).count() == 0


def test_urls(strings):
    urls = ["git@h.com:o/r.git", "ssh://git@h.com/o/r.git", "https://h.com/g/s/r.git ", "http://h.com/o/r", "git@h.com", "https://h.com",
            "ftp://x/y", "", "https://dev.azure.com/org/proj/_git/repo"]
    rows = strings(urls).select("i", G.repo_url_parts(F.col("text")).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in rows[:4]] == [
        ("ssh", "h.com", "o", "r", "h.com/o/r"), ("ssh", "h.com", "o", "r", "h.com/o/r"),
        ("https", "h.com", "g", "s/r", "h.com/g/s/r"), ("http", "h.com", "o", "r", "h.com/o/r")]
    assert rows[4].p.host == "h.com" and rows[5].p.owner == "" and tuple(rows[6].p) == ("",) * 5
    azure = strings([rows[8].p.repo, "plain"]).select(G.azure_project_repo(F.col("text")).alias("a")).collect()
    assert [tuple(r.a) for r in azure] == [("proj", "repo"), ("plain", "plain")]


def test_change_lists_fall_back_to_the_body(spark):
    df = spark.createDataFrame([("azure_devops", '{"changes": []}'), ("gitlab", "not json"), ("github", "diff --git")],
                               "forge string, body string")
    got = [r.d for r in df.select(G.assemble_diff(F.col("forge"), F.col("body")).alias("d")).collect()]
    assert got == ['{"changes": []}', "not json", "diff --git"]


def test_scalars(spark, strings):
    row = strings(["  one\ttwo  " + "x" * 70, "short  text", "y" * 70]).select("i", T.shorten_words(F.col("text"), 60).alias("s")).orderBy("i").collect()
    assert [r.s for r in row] == ["one two...", "short text", "..."]
    label = spark.range(1).select(T.finding_label(F.lit(True), F.lit("AWS Key"), F.lit("config.env"), F.lit("abc123def456ghi789")).alias("x"))
    assert label.first().x == "[VERIFIED] AWS Key in config.env @ abc123def456"


def test_summary_of_nothing(spark):
    commits = spark.createDataFrame([], "ts timestamp_ntz, classification string")
    found = spark.createDataFrame([], "verified boolean")
    row = M.run_summary(commits, found).first()
    assert (row.commits_seen, row.total_findings, row.hours_scanned, row.duration) == (0, 0, 0, "unknown")


def test_times_in_several_layouts_and_ids_that_are_no_numbers(spark):
    from hushgate.operators.events import sample_by_hash, sample_commits, unread_times, utc_time

    texts = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123Z", "2024-01-01T02:00:00+02:00", "2024-01-01 00:00:00 UTC",
             "2024-01-01 00:00:00 +0000", "yesterday"]
    raw = spark.createDataFrame([(t, "PushEvent") for t in texts], "created_at string, type string")
    got = [str(r.t) for r in raw.coalesce(1).select(utc_time(raw.created_at).alias("t")).collect()]
    assert got[0] == got[2] == got[3] == got[4] == "2024-01-01 00:00:00" and got[1].startswith("2024-01-01 00:00:00.123") and got[5] == "None"
    assert [(r.created_at, r.events) for r in unread_times(raw).collect()] == [("yesterday", 1)]
    ids = spark.range(200_000).selectExpr("id AS event_id", "'a/b' AS repo", "cast(id AS string) AS sha")
    assert 2 <= sample_by_hash(ids, 0.00005).count() <= 30 and 2 <= sample_commits(ids, 0.00005).count() <= 30


def test_ids_of_any_kind_tell_rows_apart(spark):
    raw = spark.createDataFrame(
        [(i, "PushEvent", "2024-01-01T00:00:0%dZ" % s, ("o/r",), (h, None, None, None, None)) for i, s, h in
         [("7", 1, "a"), ("007", 1, "a"), ("ab-1", 1, "a"), (None, 1, "a"), (None, 2, "a"), ("ab-2", 0, "b"), (None, 1, "b"), ("-4", 5, "c"),
          ("99999999999999999999", 5, "c")]], RAW_EVENT)
    keyed = E.keyed_events(raw)
    rows = E.first_seen(keyed, "sha").collect()
    assert len({r.event_id for r in rows}) == 9 and {r.event_id for r in rows if r.event_id >= 0} == {7}
    assert sorted(r.sha for r in rows if not r.cache_hit) == ["a", "b", "c"]
    assert next(r.ts.second for r in rows if r.sha == "b" and not r.cache_hit) == 0
    many = spark.range(4000).select(F.concat(F.lit("ab-"), F.col("id").cast("string")).alias("id"))
    kept = E.sample_by_hash(many.select(E.event_number(F.col("id")).alias("event_id")), 0.25).count()
    assert 850 < kept < 1150


def test_firsts_are_hash_aggregates(spark):
    raw = spark.createDataFrame([("1", "PushEvent", "2024-01-01T00:00:00Z", ("o/r",), ("a", None, None, None, [(("x@b.example",), (None,))]))], RAW_EVENT)
    domains = spark.createDataFrame([("b.example",)], "domain string")
    for df in (E.first_seen(E.keyed_events(raw), "sha"), A.attribute_by_email(raw, domains),
               A.attribute_events(raw, spark.createDataFrame([("z",)], "handle string"), domains)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert A.attribute_by_email(raw, domains).first().matched_value == "b.example"
