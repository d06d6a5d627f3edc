"""Reports as ordered rows of text and as JSON lines.

A report reads its inputs several times, so pass stored tables (or use
``sources.store.stage``) and detection itself runs once. Listings are limited or
have one line per detector; what grows with the data (all commits, all findings)
only goes to the JSON report, one line each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushgate.functions import secrets as S
from hushgate.functions.text import dash_if_empty, thousands
from hushgate.operators import summary as A
from hushgate.sources.store import stage

RULE = "═" * 72
STATS = ["patterns", "regex_tier1", "regex_tier2", "llm", "cache_hit"]

Block = tuple[int, list["str | Column"], "Column | None"]


def _fixed_lines(summary: DataFrame, blocks: list[Block]) -> DataFrame:
    """Headings and counters: all blocks out of the one summary row, read once.

    A block is ``(section, lines, condition)`` and is left out when its
    condition does not hold.
    """
    rows = []
    for section, lines, condition in blocks:
        for pos, line in enumerate(lines):
            text = F.lit(line) if isinstance(line, str) else line
            row = F.struct(F.lit(section).alias("section"), F.lit(pos).alias("pos"), text.alias("line"))
            rows.append(row if condition is None else F.when(condition, row))
    return (summary.select(F.explode(F.array(*rows)).alias("r"))
            .filter(F.col("r").isNotNull()).select("r.*"))


def _listing(df: DataFrame, section: int, line: Column, *order: Column | str) -> DataFrame:
    """Lines of a listing that a limit keeps short."""
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    return df.select(F.lit(section).alias("section"), rank.alias("pos"), line.alias("line"))


def _long_listing(df: DataFrame, section: int, line: Column, *order: Column | str) -> DataFrame:
    """The same without a limit: detector names of other scanners are free text, so their number has no bound.

    A range sort is stored with each row's place in its range; only the sizes
    of the ranges are put in one order.
    """
    place = F.monotonically_increasing_id()  # the range above, the place within it in the lower 33 bits
    rows = stage(df.orderBy(*order).select(line.alias("line"), place.alias("_place"))
                 .select("line", F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_at")), "listing")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("_range").agg(F.count("*").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return rows.join(starts, "_range").select(F.lit(section).alias("section"), (F.col("_start") + F.col("_at")).cast("int").alias("pos"), "line")


def _joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).orderBy("section", "pos")


def _count(name: str) -> Column:
    return F.col(name).cast("string")


def report_markdown(summary: DataFrame, findings: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Markdown lines ``(section, pos, line)``."""
    def fact(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{name}:** "), value)

    some_findings = F.col("total_findings") > 0
    blocks: list[Block] = [
        (0, ["# Secret Scan Report", "",
             fact("Scan period", F.concat_ws(" — ", F.col("start_time").cast("string"),
                                             F.coalesce(F.col("end_time").cast("string"), F.lit("running")))),
             fact("Duration", F.col("duration")),
             fact("Hours scanned", _count("hours_scanned")),
             fact("Commits seen", thousands(F.col("commits_seen"))),
             fact("Suspicious commits flagged", _count("suspicious_count")),
             fact("Verified secrets found", _count("verified_count")),
             fact("Total findings", _count("total_findings")), ""], None),
        (1, ["## Verified Findings by Detector", "", "| Detector | Count |", "|----------|-------|"],
         some_findings),
        (3, ["", "## Sample Verified Findings", "", "| Detector | Repository | Commit | File |",
             "|----------|------------|--------|------|"], some_findings),
        (5, ["", "## Suspicious Commits (by message classification)", "",
             "| Repository | Commit | Message |", "|------------|--------|---------|"],
         F.col("suspicious_count") > 0),
    ]
    table = _long_listing(A.verified_detector_table(findings), 2,
                          F.format_string("| %s | %d |", "detector", "findings"), F.desc("findings"), "detector")
    sample = _listing(A.sample_findings(findings, 20), 4,
                      F.format_string("| %s | %s | `%s` | %s |", F.col("detector"),
                                      dash_if_empty(F.col("repository")), F.col("commit"),
                                      dash_if_empty(F.col("file"))),
                      "repository", "commit", "file", "detector")
    commits = _listing(A.suspicious_listing(suspicious, 30), 6,
                       F.format_string("| %s | `%s` | %s |", "repo", "sha", "message"),
                       "repo", "sha", "message")
    return _joined(_fixed_lines(summary, blocks), table, sample, commits)


def report_text(summary: DataFrame, findings: DataFrame, stats: DataFrame,
                errors: DataFrame | None = None) -> DataFrame:
    """Terminal summary lines ``(section, pos, line)``."""
    def fact(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {name:<14}: "), value)

    some_findings = F.col("total_findings") > 0
    blocks: list[Block] = [
        (0, [RULE, "  Secret Scan Report", RULE,
             fact("Scanned hours", _count("hours_scanned")),
             fact("Commits seen", thousands(F.col("commits_seen"))),
             fact("Suspicious", _count("suspicious_count")),
             fact("Verified", _count("verified_count")),
             fact("Total findings", _count("total_findings")),
             fact("Duration", F.col("duration"))], None),
        (2, ["", "  Top detectors (verified):"], some_findings),
        (4, ["", "  Sample verified findings:"], some_findings),
        (9, [RULE], None),
    ]
    stat_lines: list[Block] = [
        (1, ["", "  Classifier stats:"] + [F.concat(F.lit(f"    {s}: "), _count(s)) for s in STATS], None)]
    top = _listing(A.top_detectors(findings), 3,
                   F.format_string("    %s: %d", "detector", "findings"), F.desc("findings"), "detector")
    sample = _listing(A.sample_findings(findings, 5), 5,
                      F.format_string("    [%s] %s @ %s  (%s)", "detector", "repository", "commit", "file"),
                      "repository", "commit", "file", "detector")
    parts = [_fixed_lines(summary, blocks), _fixed_lines(stats, stat_lines), top, sample]
    if errors is not None:
        some = A.first_errors(errors, 5)
        parts += [_fixed_lines(some.limit(1), [(7, ["", F.format_string("  Errors (%d):", "errors")], None)]),
                  _listing(some, 8, F.concat(F.lit("    ! "), F.col("line")), "line")]
    return _joined(*parts)


def report_json(summary: DataFrame, findings: DataFrame, suspicious: DataFrame,
                stats: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """The whole report as JSON lines ``(section, body)``.

    The lists that grow with the data are one line per entry, so no task builds
    a document that holds them all. Entries carry fingerprints and redacted
    messages only.
    """
    def section(df: DataFrame, name: str, *cols: Column | str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*cols)).alias("body"))

    counters = [c for c in summary.columns if not c.endswith("_time")]
    parts = [
        section(summary, "summary", F.col("start_time").cast("string").alias("start_time"),
                F.col("end_time").cast("string").alias("end_time"), *counters),
        section(suspicious, "suspicious_commits", "repo", "sha",
                S.redact_text(F.col("message")).alias("message"), "classification",
                F.col("ts").cast("string").alias("timestamp")),
        section(findings, "findings", "detector",
                F.coalesce("verified", F.lit(False)).alias("verified"), "commit", "file",
                "repository", "email", "secret_redacted", "secret_fp"),
    ]
    if stats is not None:
        parts.append(section(stats, "classifier_stats", *STATS))
    if errors is not None:
        parts.append(section(errors, "errors", S.redact_text(F.col("line")).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def write_report_json(report: DataFrame, path: str) -> None:
    """One folder of JSON lines per section."""
    report.write.mode("overwrite").partitionBy("section").text(path)


def write_report_lines(report: DataFrame, path: str) -> None:
    """One text file of the ordered lines; a report has a bounded number of them."""
    report.orderBy("section", "pos").select("line").coalesce(1).write.mode("overwrite").text(path)
