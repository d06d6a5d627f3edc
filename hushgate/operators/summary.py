"""Aggregates over commits and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.functions import secrets as S
from hushgate.functions.text import (hour_of, null_if_empty, run_duration, short_sha, shorten_words,
                                     truncate_ellipsis)
from hushgate.functions.verdict import SUSPICIOUS

FINDING_ORDER = ["timestamp", "repository", "commit", "file", "detector", "secret_fp"]


def detector_counts(findings: DataFrame) -> DataFrame:
    return (findings.groupBy("detector").agg(F.count("*").alias("findings"))
            .orderBy(F.desc("findings"), "detector"))


def verified_detector_table(findings: DataFrame) -> DataFrame:
    return detector_counts(findings.filter("verified"))


def top_detectors(findings: DataFrame, n: int = 10) -> DataFrame:
    return verified_detector_table(findings).limit(n)


def sample_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` verified findings."""
    return (findings.filter("verified").orderBy(*FINDING_ORDER).limit(n)
            .select("detector", "repository", short_sha(F.col("commit")).alias("commit"), "file"))


def suspicious_listing(suspicious: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` suspicious commits, messages redacted before they are shortened."""
    return (suspicious.orderBy("ts", "repo", "sha", "event_id").limit(n)
            .select("repo", short_sha(F.col("sha")).alias("sha"),
                    shorten_words(S.redact_text(F.col("message"))).alias("message")))


def suspicious_table(suspicious: DataFrame, width: int = 50) -> DataFrame:
    return suspicious.select(
        "repo", short_sha(F.col("sha")).alias("sha"),
        truncate_ellipsis(S.redact_text(F.col("message")), width).alias("message"))


def first_errors(errors: DataFrame, n: int = 5, line: str = "line", width: int | None = None) -> DataFrame:
    """The first ``n`` error lines, redacted, each with the total count; ``width`` cuts them, else they are whole."""
    total = errors.agg(F.count("*").alias("total")).select("total").scalar()
    shown = S.redact_text(F.col(line))
    return (errors.orderBy(line).limit(n)
            .select(total.alias("errors"), (truncate_ellipsis(shown, width) if width else shown).alias("line")))


def finding_distincts(findings: DataFrame) -> DataFrame:
    """Distinct non-empty files, mail addresses and repositories."""
    return findings.agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_count"),
        F.countDistinct(null_if_empty(F.col("file"))).alias("unique_files"),
        F.countDistinct(null_if_empty(F.col("email"))).alias("unique_emails"),
        F.countDistinct(null_if_empty(F.col("repository"))).alias("unique_repos"))


def finding_distincts_approx(findings: DataFrame, rsd: float = 0.02) -> DataFrame:
    """The same with sketches: one pass, no shuffle of distinct values."""
    def about(c: str):
        return F.approx_count_distinct(null_if_empty(F.col(c)), rsd)

    return findings.agg(
        F.count("*").alias("total_findings"),
        about("file").alias("unique_files"),
        about("email").alias("unique_emails"),
        about("repository").alias("unique_repos"))


#: Sketches have 2^LG_K registers: a standard error of about 0.8 % at 14.
LG_K = 14
SKETCHED = {"unique_files": "file", "unique_emails": "email", "unique_repos": "repository"}


def distinct_sketches(findings: DataFrame, part: str) -> DataFrame:
    """Counts and sketches of distinct values for each ``part``, such as an hour: rows to store and to merge later."""
    return findings.groupBy(part).agg(
        F.count("*").alias("total_findings"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_count"),
        *[F.hll_sketch_agg(null_if_empty(F.col(c)), LG_K).alias(name) for name, c in SKETCHED.items()])


def merge_sketches(stored: DataFrame, *by: str) -> DataFrame:
    """Totals and estimated distinct values over stored parts; values that occur in many parts count once."""
    return stored.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_findings", "verified_count")],
        *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in SKETCHED])


def finding_repositories(findings: DataFrame) -> DataFrame:
    """Distinct repositories with findings, as rows so that no task holds them all."""
    return findings.filter(F.col("repository") != "").select("repository").distinct()


def run_summary(classified: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: hours, commits, suspicious, verified, findings and covered time.

    Each input is read once; the two one-row results are folded together.
    """
    commits = classified.agg(
        F.countDistinct(hour_of(F.col("ts"))).alias("hours_scanned"),
        F.count("*").alias("commits_seen"),
        F.count_if(F.col("classification") == SUSPICIOUS).alias("suspicious_count"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    found = findings.agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_count"))
    both = commits.unionByName(found, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "start_time", "end_time",
        run_duration(F.col("start_time"), F.col("end_time")).alias("duration"),
        "hours_scanned", "commits_seen", "suspicious_count", "verified_count", "total_findings")
