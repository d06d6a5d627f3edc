"""One registered query per operator, over whole tables."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.catalog import views as v
from hushgate.functions import forge as G
from hushgate.functions import secrets as S
from hushgate.functions import text as T
from hushgate.functions import verdict as V
from hushgate.operators import attribute as A
from hushgate.operators import classify as C
from hushgate.operators import detect as D
from hushgate.operators import events as E
from hushgate.operators import resolve as R
from hushgate.operators import review as W
from hushgate.operators import summary as M
from hushgate.plans import report as P
from hushgate.plans import scan as N
from hushgate.sources import archive, domains, findings as finding_files, store
from hushgate.streaming import live, monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FORGES = ["github", "gitlab", "bitbucket", "azure_devops", "sourceforge", "gitea", "gogs", "git.example"]
CUSTOM_WORDS = {
    "high_verbs": ["rotate", "expose"], "high_nouns": ["credentials.", "database"],
    "broad_verbs": ["add", "update"], "broad_nouns": ["feature", "readme"],
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _keyed(spark, sf) -> DataFrame:
    return N.commit_events(v.raw_events(spark, sf))


def _resolved(spark, sf) -> DataFrame:
    return R.resolve_messages(_keyed(spark, sf), v.commits(spark, sf))


def _classified(spark, sf) -> DataFrame:
    return C.classify(_resolved(spark, sf))


def _attributed(spark, sf) -> DataFrame:
    return A.attribute_events(v.raw_events(spark, sf), v.orgs(spark, sf), v.domains(spark, sf))


# ---- sources and sinks ---------------------------------------------------

def _archive_folder(spark, sf) -> str:
    path = store.new_path(spark, "archive")
    v.archive_lines(spark, sf).write.option("compression", "gzip").text(path)
    return path


@query
def read_archive_events(spark, sf):
    return archive.read_archive_events(spark, _archive_folder(spark, sf)).select(
        "id", "type", "created_at", F.col("repo.name").alias("repo"), "payload.head", "payload.ref",
        "payload.action", F.col("payload.pull_request.number").alias("pr_number"),
        F.coalesce(F.size("payload.commits"), F.lit(-1)).alias("n_commits"))


#: Broken archives beside the good ones: their names and what they hold.
BROKEN_ARCHIVES = {
    "2024-02-01-0.json.gz": gzip.compress(b'{"id": "1", "type": "PushEvent"}\n' * 5000, mtime=0)[:90],
    "2024-02-01-1.json.gz": b"no archive at all",
}


@query
def archive_errors(spark, sf):
    """Events of the archives that can be read, and a row for each that cannot."""
    path = _archive_folder(spark, sf)
    for name, data in BROKEN_ARCHIVES.items():
        store.write_bytes(spark, f"{path}/{name}", data)
    lines, files = archive.read_archive_safely(spark, path)
    events = lines.filter(F.col(archive.CORRUPT).isNull()).groupBy("type").agg(F.count("*").alias("events"))
    return (events.select(F.col("type").alias("what"), F.lit("").alias("error"), "events")
            .unionByName(archive.archive_errors(files).select(F.concat("file", F.lit(" "), F.date_format("archive_hour", "HH")).alias("what"),
                                                              "error", F.lit(0).cast("long").alias("events"))))


@query
def corrupt_lines(spark, sf):
    return archive.corrupt_lines(spark, _archive_folder(spark, sf)).select("line")


@query
def hour_range(spark, sf):
    bounds = v.table(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return archive.hour_range(bounds, F.col("a"), F.col("b"))


@query
def hour_range_back(spark, sf):
    bounds = v.table(spark, sf, "events").agg(F.max("ts").alias("b"))
    return archive.hour_range(bounds, None, F.col("b"), hours_back=6)


@query
def events_in_hours(spark, sf):
    start, end = F.lit("2024-01-10 03:20:00").cast("timestamp_ntz"), F.lit("2024-01-12 05:40:00").cast("timestamp_ntz")
    return archive.in_hours(v.commit_events(spark, sf), start, end).select("event_id", "ts")


@query
def latest_hour(spark, sf):
    return archive.latest_hour(v.commit_events(spark, sf), F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"))


@query
def archive_hour_path(spark, sf):
    path = archive.archive_hour_path(F.col("ts"))
    return (v.commit_events(spark, sf).select(path.alias("path")).distinct()
            .withColumn("hour", archive.hour_from_path(F.col("path"))))


@query
def read_findings(spark, sf):
    path = store.new_path(spark, "scanner")
    v.scanner_lines(spark, sf).select("value").write.text(path)
    return finding_files.read_findings(spark, path, v.SALT)


@query
def write_findings_csv(spark, sf):
    path = store.new_path(spark, "csv")
    found = v.findings(spark, sf).withColumn("verified", F.coalesce("verified", F.lit(False)))
    finding_files.write_findings_csv(found, path)
    return finding_files.read_findings_csv(spark, path)


def _report_inputs(spark, sf):
    classified = store.stage(_classified(spark, sf), "classified")
    found = store.stage(v.findings(spark, sf), "findings")
    return (store.stage(M.run_summary(classified, found), "summary"), found,
            C.suspicious_only(classified), store.stage(C.classifier_stats(classified), "stats"))


@query
def write_report_json(spark, sf):
    summary, found, suspicious, stats = _report_inputs(spark, sf)
    path = store.new_path(spark, "report")
    P.write_report_json(P.report_json(summary, found, suspicious, stats), path)
    return spark.read.text(path).select("section", F.col("value").alias("body"))


@query
def report_markdown(spark, sf):
    summary, found, suspicious, _ = _report_inputs(spark, sf)
    return P.report_markdown(summary, found, suspicious)


@query
def report_text(spark, sf):
    summary, found, _, stats = _report_inputs(spark, sf)
    return P.report_text(summary, found, stats)


def _domain_texts(spark, sf):
    return v.table(spark, sf, "pages").select(F.concat_ws(
        "\n", F.lit("owner,Domain"), F.col("url"), F.lit("  Someone@GMAIL.com "),
        F.concat(F.lit("it@corp"), v.text_of(F.col("page_id") % 40), F.lit(".co.uk")),
        F.concat(F.lit("sub domain skipped"), v.text_of("page_id"), F.lit(".com"))).alias("text"))


@query
def write_domain_list(spark, sf):
    path = store.new_path(spark, "domains")
    domains.write_domain_list(domains.extract_domains(_domain_texts(spark, sf)), path, "pages")
    return domains.read_domain_summary(spark, path)


@query
def read_domain_list(spark, sf):
    path = store.new_path(spark, "domains")
    domains.write_domain_list(domains.extract_domains(_domain_texts(spark, sf)), path, "pages")
    return domains.read_domain_list(spark, path)


@query
def extract_domains(spark, sf):
    return domains.extract_domains(_domain_texts(spark, sf))


@query
def union_domain_lists(spark, sf):
    return domains.union_domain_lists(domains.extract_domains(_domain_texts(spark, sf)), v.domains(spark, sf))


@query
def write_by_hour(spark, sf):
    path = store.new_path(spark, "by-hour")
    events, noon = v.commit_events(spark, sf), F.hour("ts") < 12
    store.write_by_hour(events.filter(noon), path, files_per_hour=1)  # the second call keeps the hours of the first
    store.write_by_hour(events.filter(~noon), path, files_per_hour=1)
    return store.read_by_hour(spark, path, "2024-01-10-03", "2024-01-12-05").select("event_id", "hour")


# ---- projections and filters ---------------------------------------------

@query
def push_events(spark, sf):
    return E.push_events(v.raw_events(spark, sf))


@query
def pr_events(spark, sf):
    return E.pr_events(v.raw_events(spark, sf))


@query
def union_events(spark, sf):
    raw = v.raw_events(spark, sf)
    return E.union_events(E.push_events(raw), E.pr_events(raw)).select(
        "event_id", "event_type", "repo", "ts", T.or_empty(F.col("head")).alias("head"),
        T.or_empty(F.col("title")).alias("title"))


@query
def commit_key(spark, sf):
    return _keyed(spark, sf)


@query
def first_line(spark, sf):
    return v.commit_events(spark, sf).select("event_id", T.first_line(F.col("message")).alias("line"))


@query
def message_by_forge(spark, sf):
    return v.payloads(spark, sf).select(
        "event_id", "forge", G.message_by_forge(F.col("forge"), F.col("body")).alias("message"))


@query
def assemble_diff(spark, sf):
    return v.change_lists(spark, sf).select(
        "doc_id", "forge", G.assemble_diff(F.col("forge"), F.col("body")).alias("diff"))


@query
def diff_lines(spark, sf):
    return D.diff_lines(v.diffs(spark, sf))


@query
def diff_added_lines(spark, sf):
    return D.diff_added_lines(v.diffs(spark, sf))


@query
def suspicious_only(spark, sf):
    return C.suspicious_only(_classified(spark, sf)).select("event_id", "repo", "sha", "message")


@query
def only_verified(spark, sf):
    return D.only_verified(v.findings(spark, sf)).select("detector", "commit", "secret_fp", "pos")


@query
def skip_diffs(spark, sf):
    run = N.scan(v.raw_events(spark, sf), v.commits(spark, sf), v.diffs(spark, sf), v.SALT, skip_diffs=True)
    return run.classified.groupBy("classification").agg(F.count("*").alias("commits"))


@query
def sample_events(spark, sf):
    return E.sample_events(_keyed(spark, sf), 0.3, seed=7).select("event_id", "repo", "sha")


@query
def sample_by_hash(spark, sf):
    return E.sample_by_hash(_keyed(spark, sf), 0.3, seed=7).select("event_id", "repo", "sha")


@query
def sample_commits(spark, sf):
    return E.sample_commits(_keyed(spark, sf), 0.3).select("event_id", "repo", "sha")


@query
def max_commits(spark, sf):
    return E.max_commits(C.suspicious_only(_classified(spark, sf)), 25).select("event_id", "repo", "sha", "ts")


# ---- classification ------------------------------------------------------

def _messages(spark, sf) -> DataFrame:
    return v.commit_events(spark, sf).select("event_id", "ts", "sha", "message")


@query
def message_key(spark, sf):
    return _messages(spark, sf).select("event_id", T.message_key(F.col("message")).alias("message_key"))


@query
def match_removal_patterns(spark, sf):
    return _messages(spark, sf).select("event_id", V.match_removal_patterns(F.col("message")).alias("rule_id"))


@query
def match_sweep_patterns(spark, sf):
    return _messages(spark, sf).select("event_id", V.match_sweep_patterns(F.col("message")).alias("rule_id"))


def _tokens() -> Column:
    return V.tokenize(T.message_key(F.col("message")))


@query
def tokenize(spark, sf):
    return _messages(spark, sf).select("event_id", F.explode(_tokens()).alias("token"))


@query
def tier1(spark, sf):
    return _messages(spark, sf).select("event_id", V.tier1(_tokens()).alias("hit"))


@query
def tier2(spark, sf):
    return _messages(spark, sf).select("event_id", V.tier2(_tokens()).alias("hit"))


CLASSES = ["event_id", "classification", "tier", "rule_id"]


@query
def classify(spark, sf):
    return C.classify(_messages(spark, sf)).select(*CLASSES)


@query
def classify_with_rules(spark, sf):
    return C.classify_with_rules(_messages(spark, sf), CUSTOM_WORDS).select(*CLASSES)


@query
def classify_with_rule_table(spark, sf):
    words = [F.struct(F.lit(s).alias("word_set"), F.lit(w).alias("word"))
             for s, ws in CUSTOM_WORDS.items() for w in ws]
    table = spark.range(1).select(F.inline(F.array(*words)))
    return C.classify_with_rules(_messages(spark, sf), table).select(*CLASSES)


@query
def classify_batch(spark, sf):
    return C.classify_batch(_resolved(spark, sf)).select("event_id", "repo", "sha", "classification")


@query
def score_unresolved(spark, sf):
    # Local, so that it travels by value to workers that cannot import this module.
    def ends_like_a_feature(keys: pd.Series) -> pd.Series:
        return keys.str.endswith("e") | keys.str.contains("env")

    C.register_scorer("feature-words", ends_like_a_feature)
    return C.score_unresolved(_messages(spark, sf), "feature-words").select(*CLASSES)


@query
def classifier_stats(spark, sf):
    return C.classifier_stats(_messages(spark, sf), model_calls=True)


def _open_keys(spark, sf) -> DataFrame:
    """Undecided messages; made distinct per user, so that there are many."""
    return (C.with_code(v.commit_events(spark, sf)).filter(F.col("_code") == 0)
            .select(F.concat_ws(" ", "message_key", v.text_of("user_id")).alias("message_key")))


@query
def build_review_prompt(spark, sf):
    return W.build_review_prompt(_messages(spark, sf)).select("event_id", "prompt")


@query
def build_review_batches(spark, sf):
    numbered = W.number_for_review(_open_keys(spark, sf), size=10, buckets=8)
    return W.build_review_batches(numbered).select("batch_id", "messages", "prompt")


@query
def parse_review_verdicts(spark, sf):
    return W.parse_review_verdicts(v.review_replies(spark, sf))


@query
def apply_review_verdicts(spark, sf):
    numbered = W.number_for_review(_open_keys(spark, sf), size=10, buckets=8)
    reply = F.when(F.length("prompt") % 3 == 0, F.lit("broken")) \
             .otherwise(F.lit('```json\n{"0": true, "3": true, "4": false}\n```'))
    replies = W.build_review_batches(numbered).select("batch_id", reply.alias("reply"))
    return W.apply_review_verdicts(numbered, W.parse_review_verdicts(replies)).select(
        "batch_id", "idx", "message_key", "classification")


@query
def apply_single_replies(spark, sf):
    reply = v.pick(["true", " True, it does", "false", ""], F.col("event_id"))
    replied = _messages(spark, sf).withColumn("reply", F.when(F.col("event_id") % 9 != 4, reply))
    return W.apply_single_replies(replied).select("event_id", "classification")


@query
def credential_kind_by_prefix(spark, sf):
    key = F.concat(v.pick(["sk-ant-", "sk-", "AIza", "xx"], F.col("event_id")), F.col("sha"))
    return v.commit_events(spark, sf).select("event_id", V.credential_kind_by_prefix(key).alias("kind"))


# ---- attribution ---------------------------------------------------------

@query
def org_handle(spark, sf):
    return v.commit_events(spark, sf).select(
        "event_id", F.coalesce(A.org_handle(F.col("repo")), F.lit("unknown")).alias("org_handle"))


@query
def attribute_by_org(spark, sf):
    return A.attribute_by_org(v.commit_events(spark, sf), v.orgs(spark, sf)).select(
        "event_id", "org_handle", "org_owned")


@query
def email_domain(spark, sf):
    return v.raw_events(spark, sf).select("id", F.posexplode("payload.commits").alias("pos", "c")).select(
        "id", "pos", T.email_domain(F.col("c.author.email")).alias("author"),
        T.email_domain(F.col("c.committer.email")).alias("committer"))


@query
def attribute_by_email(spark, sf):
    return A.attribute_by_email(v.raw_events(spark, sf), v.domains(spark, sf))


OWNED = ["id", "org_handle", "is_owned", "matched_via", "matched_value", "label"]


@query
def attribute_events(spark, sf):
    return _attributed(spark, sf).select(*OWNED)


@query
def attribute_events_by_list(spark, sf):
    return A.attribute_events(v.raw_events(spark, sf), [f"org{n}" for n in range(0, 25, 2)],
                              [f"mail{n}.example" for n in (1, 3, 5)]).select(*OWNED)


@query
def owned_only(spark, sf):
    return A.owned_only(_attributed(spark, sf)).select("id", "label")


@query
def not_owned(spark, sf):
    return A.not_owned(_attributed(spark, sf)).select("id", "label")


# ---- joins and sets ------------------------------------------------------

@query
def resolve_messages(spark, sf):
    return _resolved(spark, sf).select("event_id", "repo", "sha", "is_pr", "message")


@query
def unresolved_pushes(spark, sf):
    return R.unresolved_pushes(_keyed(spark, sf), v.commits(spark, sf)).select("event_id", "repo", "sha")


@query
def attach_diffs(spark, sf):
    return R.attach_diffs(C.suspicious_only(_classified(spark, sf)), v.diffs(spark, sf))


@query
def one_commit(spark, sf):
    first = v.push_keys(spark, sf).agg(F.min(F.struct("sha", "repo")).alias("m")).select("m").scalar()
    return R.one_commit(v.diffs(spark, sf), first["repo"], first["sha"])


@query
def distinct_commits(spark, sf):
    return E.distinct_commits(_keyed(spark, sf)).select("repo", "sha", "event_id", "ts", "ref")


# ---- detection -----------------------------------------------------------

@query
def detect_secrets(spark, sf):
    return D.detect_secrets(v.table(spark, sf, "documents"), ["doc_id"], v.SALT)


@query
def detect_every_kind(spark, sf):
    return D.detect_secrets(v.documents_with_values(spark, sf), ["doc_id"], v.SALT)


@query
def detect_in_pages(spark, sf):
    return D.detect_secrets(v.page_texts(spark, sf), ["page_id"], v.SALT)


@query
def detect_in_conversations(spark, sf):
    return D.detect_secrets(v.table(spark, sf, "conversations"), ["conv_id", "turn"], v.SALT)


@query
def secret_entropy(spark, sf):
    return D.detect_with_entropy(v.table(spark, sf, "documents"), ["doc_id"], v.SALT)


@query
def entropy_filter(spark, sf):
    return D.detect_secrets(v.table(spark, sf, "documents"), ["doc_id"], v.SALT, min_entropy=3.7)


@query
def redact_text(spark, sf):
    return D.redact_documents(v.table(spark, sf, "documents")).select("doc_id", "text")


@query
def secret_fingerprint(spark, sf):
    return v.commit_events(spark, sf).select(
        "event_id", S.secret_fingerprint(F.col("sha"), v.SALT).alias("secret_fp"),
        S.redact_value(F.col("sha")).alias("secret_redacted"))


@query
def detector_coverage(spark, sf):
    return D.detector_coverage(v.findings(spark, sf))


@query
def clean_documents(spark, sf):
    return D.clean_documents(v.table(spark, sf, "documents")).select("doc_id", "lang", "source")


@query
def scan(spark, sf):
    return N.scan(v.raw_events(spark, sf), v.commits(spark, sf), v.diffs(spark, sf), v.SALT).findings


@query
def scan_owned(spark, sf):
    owned = v.orgs(spark, sf), v.domains(spark, sf)
    return N.scan(v.raw_events(spark, sf), v.commits(spark, sf), v.diffs(spark, sf), v.SALT, owned=owned).findings


# ---- windows, limits, order ----------------------------------------------

@query
def first_seen_key(spark, sf):
    keyed = _messages(spark, sf).withColumn("message_key", T.message_key(F.col("message")))
    return E.first_seen(keyed, "message_key").select("event_id", "message_key", "cache_hit")


@query
def top_detectors(spark, sf):
    return M.top_detectors(v.findings(spark, sf))


@query
def sample_findings(spark, sf):
    return M.sample_findings(v.findings(spark, sf), 5)


@query
def suspicious_listing(spark, sf):
    return M.suspicious_listing(C.suspicious_only(_classified(spark, sf)))


@query
def first_errors(spark, sf):
    return M.first_errors(archive.corrupt_lines(spark, _archive_folder(spark, sf)))


@query
def ordered_results(spark, sf):
    return E.ordered_results(_classified(spark, sf)).select("ts", "event_id", "classification")


# ---- aggregates ----------------------------------------------------------

@query
def run_summary(spark, sf):
    return M.run_summary(_classified(spark, sf), v.findings(spark, sf))


@query
def detector_counts(spark, sf):
    return M.detector_counts(v.findings(spark, sf))


@query
def finding_distincts(spark, sf):
    return M.finding_distincts(v.findings(spark, sf))


@query
def finding_distincts_approx(spark, sf):
    return M.finding_distincts_approx(v.findings(spark, sf))


@query
def finding_repositories(spark, sf):
    return M.finding_repositories(v.findings(spark, sf))


@query
def hourly_counts(spark, sf):
    return E.hourly_counts(v.commit_events(spark, sf))


@query
def verified_detector_table(spark, sf):
    return M.verified_detector_table(v.findings(spark, sf))


# ---- scalars -------------------------------------------------------------

@query
def short_sha(spark, sf):
    return v.commit_events(spark, sf).select("event_id", T.short_sha(F.col("sha")).alias("sha"))


@query
def truncate_ellipsis(spark, sf):
    text = F.col("text")
    return v.table(spark, sf, "documents").select("doc_id", *[
        T.truncate_ellipsis(text, n).alias(f"cut{n}") for n in (50, 60, 120)])


@query
def shorten_words(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", T.shorten_words(F.col("text"), 60).alias("short"))


@query
def repo_url_parts(spark, sf):
    return v.repo_urls(spark, sf).select("id", G.repo_url_parts(F.col("url")).alias("p")).select("id", "p.*")


@query
def forge_of_host(spark, sf):
    return v.repo_urls(spark, sf).select(
        "id", G.forge_of_host(G.repo_url_parts(F.col("url"))["host"]).alias("forge"))


@query
def azure_project_repo(spark, sf):
    parts = G.repo_url_parts(F.col("url"))
    return v.repo_urls(spark, sf).select("id", G.azure_project_repo(parts["repo"]).alias("p")).select("id", "p.*")


def _with_forge(spark, sf) -> DataFrame:
    sha = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("pr-"), v.text_of("event_id"))).otherwise(F.col("sha"))
    return v.commit_events(spark, sf).withColumn("forge", v.pick(FORGES, F.col("event_id"))).withColumn("sha", sha)


@query
def clone_url(spark, sf):
    return _with_forge(spark, sf).select("event_id", G.clone_url(F.col("repo"), F.col("forge")).alias("url"))


@query
def commit_url(spark, sf):
    return _with_forge(spark, sf).select(
        "event_id", G.commit_url(F.col("repo"), F.col("sha"), F.col("forge")).alias("url"))


@query
def diff_url(spark, sf):
    return _with_forge(spark, sf).select(
        "event_id", G.diff_url(F.col("repo"), F.col("sha"), F.col("forge")).alias("url"))


@query
def finding_label(spark, sf):
    label = T.finding_label(F.col("verified"), F.col("detector"), F.col("file"), F.col("commit"))
    return v.findings(spark, sf).select("secret_fp", "pos", label.alias("label"))


@query
def dash_if_empty(spark, sf):
    return v.commit_events(spark, sf).select("event_id", T.dash_if_empty(F.col("repo")).alias("repo"))


@query
def thousands(spark, sf):
    return v.commit_events(spark, sf).select("event_id", T.thousands(F.col("event_id") * 1234).alias("n"))


@query
def run_duration(spark, sf):
    per_user = v.commit_events(spark, sf).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    end = F.when(F.col("user_id") % 5 != 0, F.col("b"))
    return per_user.select("user_id", T.run_duration(F.col("a"), end).alias("duration"))


# ---- streaming -----------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    schema = v.table(spark, sf, "events").schema
    return v.with_commit_columns(
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query
def monitor_stream(spark, sf):
    flagged = monitor.monitor_stream(v.to_raw(_event_stream(spark, sf)), v.commits(spark, sf))
    return monitor.run_once(spark, flagged.select("event_id", "repo", "sha", "tier", "rule_id"), "monitor")


@query
def monitor_dedup(spark, sf):
    keyed = N.commit_events(v.to_raw(_event_stream(spark, sf)))
    return monitor.run_once(spark, monitor.monitor_dedup(keyed, "60 days").select("repo", "sha"), "dedup")


@query
def hourly_window_counts(spark, sf):
    return monitor.run_once(spark, monitor.hourly_window_counts(_event_stream(spark, sf)), "windows")


@query
def monitor_attribution(spark, sf):
    """Both lists of owned names as tables, looked up in each micro-batch."""
    raw = v.to_raw(_event_stream(spark, sf))
    out, state = store.new_path(spark, "attribution"), store.new_path(spark, "attribution-state")
    live.start_attribution(raw, v.orgs(spark, sf), v.domains(spark, sf), out, state).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(out).select(*OWNED)


@query
def alert_stream(spark, sf):
    saved, out, state = (store.new_path(spark, n) for n in ("findings", "alerts", "alerts-state"))
    found = v.findings(spark, sf)
    found.write.parquet(saved)
    # Readers find a schema even if no batch raises an alert.
    found.limit(0).write.parquet(f"{out}/batch=none")
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(saved)
    monitor.alert_stream(stream, out, state).awaitTermination()
    return (spark.read.schema(found.schema).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").parquet(out)
            .select("detector", "commit", "secret_fp", "pos"))


@query
def late_data(spark, sf):
    folder = store.new_path(spark, "late")
    events = v.commit_events(spark, sf).select("event_id", "ts", "kind")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    out, state = store.new_path(spark, "late-windows"), store.new_path(spark, "late-state")
    for part in (events.filter(F.col("ts") >= cut), events.filter(F.col("ts") < cut)):
        # The second half of the month arrives first; the restarted query drops the rest as late.
        part.write.mode("append").parquet(folder)
        counts = monitor.hourly_window_counts(spark.readStream.schema(events.schema).parquet(folder))
        monitor.start_to_parquet(counts, out, state).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def _files(df: DataFrame, name: str, *order: str) -> str:
    """A folder of files, as a stream would find them: as many as the rows need, though many rows have one time.

    Without an order rows stay in the partitions they come in.
    """
    path = store.new_path(df.sparkSession, name)
    (df.repartitionByRange(*order) if order else df).write.parquet(path)
    return path


def _stored_streams(spark, sf) -> tuple[DataFrame, ...]:
    """Raw events, commits and diffs as streams of files, and last rows a year on, which close all waiting."""
    raw = v.raw_events(spark, sf)
    keys = v.push_keys(spark, sf)
    stored = lambda days: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=(days % 28).cast("int"))
    commits = keys.filter(F.col("k") % 10 != 0).select("repo", "sha", "message", stored(F.col("k")).alias("stored_at"))
    # A pair of repository and hash is one key, so the time is a column of the key before texts are attached.
    some = keys.filter((F.col("user_id") + F.col("k")) % 7 != 0).withColumn("stored_at", stored(F.col("user_id")))
    diffs = v.diffs(spark, sf, some).select("repo", "sha", "diff", "stored_at")
    # Texts are written where they met their keys: copies of one stand side by side there and pack well, and none is shuffled again.
    tables = [(raw, "events", ("created_at", "id")), (commits, "commits", ("stored_at", "repo", "sha")), (diffs, "diffs", ())]
    paths = [_files(df, name, *order) for df, name, order in tables]
    end = "2025-01-01T00:00:00Z"
    last = spark.createDataFrame([("0", "PushEvent", end, ("org0/end",), ("end", None, None, None, None))], raw.schema)
    row = {"repo": F.lit("org0/end"), "sha": F.lit("end"), "message": F.lit(v.MESSAGES[0]), "diff": F.lit(""), "stored_at": F.lit(end).cast("timestamp")}
    ends = [last, *[spark.range(1).select(*[row[c].alias(c) for c in df.columns]) for df in (commits, diffs)]]
    return tuple((p, df.schema, e) for p, (df, *_), e in zip(paths, tables, ends))


def _live(spark, sf) -> str:
    """The whole monitor, run over the data and again, from its checkpoint, over the last rows."""
    streams, out, state = _stored_streams(spark, sf), store.new_path(spark, "live"), store.new_path(spark, "live-state")
    known = v.findings(spark, sf).filter("verified").select("secret_fp", "verified")
    for run in range(2):
        if run:
            for path, _, end in streams:
                end.write.mode("append").parquet(path)
        raw, commits, diffs = (spark.readStream.schema(schema).parquet(path) for path, schema, _ in streams)
        live.run_live(raw, commits, diffs, v.SALT, out, state, owned=(v.orgs(spark, sf), v.domains(spark, sf)), verified=known,
                      delay="60 days", commit_span=("10 days", "5 days"), diff_span=("60 days", "60 days"))
    return out


@query
def monitor_findings(spark, sf):
    """Owned events, commits and diffs as streams; findings of suspicious commits, with what raises an alert."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{_live(spark, sf)}/findings")
    return found.select("repo", "sha", "file", "line_no", "sign", "detector", "pos", "secret_redacted", "secret_fp",
                        F.coalesce("verified", F.lit(False)).alias("alert"))


@query
def monitor_waiting(spark, sf):
    """Pushes whose commit never came, and suspicious commits whose diff never came."""
    out = _live(spark, sf)
    flagged = spark.read.schema(live.FLAGGED).parquet(f"{out}/flagged").filter(F.col("state") == live.UNRESOLVED)
    without = live.read_batches(spark, f"{out}/without_diff", "repo string, sha string, ts timestamp")
    return (flagged.select(F.lit("commit").alias("lacks"), F.col("event_id").cast("string").alias("event_id"), "repo", "sha")
            .unionByName(without.select(F.lit("diff").alias("lacks"), F.lit("").alias("event_id"), "repo", "sha")))


@query
def late_rows(spark, sf):
    """Hours counted in two runs, the second half of the month first: what is closed, open or late is all there is."""
    events = v.commit_events(spark, sf).select("event_id", "ts", "kind")
    folder, out, state = (store.new_path(spark, n) for n in ("hours-in", "hours", "hours-state"))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    for part in (events.filter(F.col("ts") >= cut), events.filter(F.col("ts") < cut)):
        part.write.mode("append").parquet(folder)
        live.count_hours(spark.readStream.schema(events.schema).parquet(folder), out, state).awaitTermination()
    told = [live.read_batches(spark, f"{out}/{name}", "hour timestamp_ntz, kind string, events long") for name in ("closed", "late")]
    told.append(live.open_hours(spark, out))
    return told[0].select(F.lit("closed").alias("state"), "*").unionByName(told[1].select(F.lit("late").alias("state"), "*")) \
                  .unionByName(told[2].select(F.lit("open").alias("state"), "*"))


@query
def first_seen_odd_ids(spark, sf):
    """Ids such as ``007``, ``ab-1`` and none: still one first row for each commit, the earliest."""
    eid = F.col("id").cast("bigint")
    odd = (F.when(eid % 11 == 0, F.lit(None)).when(eid % 3 == 0, F.concat(F.lit("00"), "id"))
            .when(eid % 3 == 1, F.concat(F.lit("ab-"), "id")).otherwise(F.col("id")))
    keyed = N.commit_events(v.raw_events(spark, sf).withColumn("id", odd))
    seen = E.first_seen(keyed.withColumn("commit", F.concat("repo", F.lit("@"), "sha")), "commit")
    return seen.groupBy("commit").agg(F.count("*").alias("events"), F.count_if("cache_hit").alias("hits"),
                                      F.min(F.when(~F.col("cache_hit"), F.col("ts"))).alias("first_ts"))


@query
def review_batches_full(spark, sf):
    """Batches that are full but for the last, numbered over buckets that follow the number of messages."""
    numbered = W.number_in_full_batches(_open_keys(spark, sf), size=10, per_bucket=100)
    return W.build_review_batches(numbered).select("batch_id", "messages", "prompt")


@query
def finding_distincts_merged(spark, sf):
    """Sketches stored part by part and merged: whether each estimate lies within a twentieth of the exact number."""
    found, path = store.stage(v.findings(spark, sf), "findings"), store.new_path(spark, "sketches")
    parts = found.withColumn("part", F.substring("timestamp", 2, 1))
    for half in ("part < '8'", "part >= '8'"):
        M.distinct_sketches(parts.filter(half), "part").write.mode("append").parquet(path)
    about, exact = M.merge_sketches(spark.read.parquet(path)).first(), M.finding_distincts(found).first()
    near = {c: abs(about[c] - exact[c]) <= 0.05 * exact[c] for c in M.SKETCHED}
    return spark.createDataFrame([(about.total_findings, about.verified_count, *near.values())],
                                 "total_findings long, verified_count long, " + ", ".join(f"{c} boolean" for c in near))


@query
def scan_hours(spark, sf):
    """Findings of two days, from diffs stored by the hour of the first push that named them."""
    path, pushed = store.new_path(spark, "diffs-by-hour"), N.commit_events(v.raw_events(spark, sf)).filter(~F.col("is_pr"))
    # The time joins the keys; texts are attached after it and shuffled once, into their hours.
    first = v.push_keys(spark, sf).join(pushed.groupBy("repo", "sha").agg(F.min("ts").alias("ts")), ["repo", "sha"])
    stored = v.diffs(spark, sf, first)
    store.write_by_hour(stored, path, files_per_hour=1)
    return N.scan_hours(v.raw_events(spark, sf), v.commits(spark, sf), path, v.SALT, "2024-01-10-00", "2024-01-12-00", look_back=48).findings


@query
def report_text_errors(spark, sf):
    """The terminal report of a run whose archives hold broken lines."""
    summary, found, _, stats = _report_inputs(spark, sf)
    return P.report_text(summary, found, stats, archive.corrupt_lines(spark, _archive_folder(spark, sf)))


@query
def scan_one(spark, sf):
    """One commit by address: the first, in order of its hash, whose document holds something."""
    docs = v.table(spark, sf, "documents")
    n = docs.count()
    holding = D.detect_secrets(docs, ["doc_id"], v.SALT).select("doc_id").distinct()
    keys = v.push_keys(spark, sf).filter(F.size(F.split("repo", "/")) == 2).withColumn("doc_id", (F.col("user_id") * 100 + F.col("k")) % n)
    sha, repo = keys.join(holding, "doc_id", "left_semi").agg(F.min(F.struct("sha", "repo")).alias("m")).select("m.*").first()
    return N.scan_one(f"git@github.com:{repo}.git", sha, v.commits(spark, sf), v.diffs(spark, sf), v.SALT).findings
