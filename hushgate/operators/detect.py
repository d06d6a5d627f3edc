"""Detection of credential-shaped strings in tables of text.

Raw values live only between the match and the fingerprint, inside one stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgate.functions import secrets as S
from hushgate.rules import DETECTOR_CATALOG, DETECTORS, GENERIC_DETECTORS, MULTI_LINE, Detector

# Two header lines are a file's only where a hunk follows: a removed line "-- a/x" and an
# added line "++ b/x" look like them within a hunk.
NAMES = r"--- (?:a/|/dev/null)[^\n]*\n\+\+\+ (?:b/|/dev/null)[^\n]*"
FILE_START = rf"(?m)^(?=diff --git |{NAMES}\n@@ )"
HUNK_START = r"(?m)^(?=@@ )"
HUNK_HEADER = r"^@@ [^\n]*\n?"


def changed_hunks(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs with their changed lines: ``(repo, sha, file, added, removed)``.

    A diff is cut into files, a file into hunks, and the lines of a hunk count up
    from the starts its header names: added lines by their place in the new file,
    removed lines by their place in the old one. All cuts happen within the row:
    no shuffle and no window, however large a single diff is.
    """
    files = diffs.select("repo", "sha", F.explode(F.split("diff", FILE_START)).alias("part"))
    named = F.regexp_extract("part", r"^--- [^\n]*\n\+\+\+ b/([^\n]*)", 1)
    file = F.when(named != "", named) \
            .when(F.col("part").startswith("--- "), F.regexp_extract("part", r"^--- a/([^\n]*)", 1)) \
            .otherwise(F.regexp_extract("part", r"^diff --git a/[^\n]* b/([^\n]*)", 1))
    # What stands before the first hunk is header; a file without any hunk
    # header is one hunk from its first line on, its names left out.
    bare = F.regexp_replace(F.regexp_replace("part", r"^diff --git [^\n]*\n?", ""), rf"(?m)^{NAMES}\n?", "")
    body = F.when(F.col("part").contains("\n@@ "), F.regexp_replace("part", rf"^{NAMES}\n", "")).otherwise(bare)
    pieces = F.filter(F.split(body, HUNK_START),
                      lambda p: p.startswith("@@ ") | ~F.col("part").contains("\n@@ "))
    # Every step that computes a column ends before the next explode: computed
    # next to an explode, it would be evaluated for every line, and every line
    # would carry the whole text it came from. The explodes are outer ones, as
    # an inner explode of a column makes Spark compute that column twice, once
    # for a filter on its size.
    cut = files.select("repo", "sha", file.alias("file"), pieces.alias("hunks"))
    hunks = cut.select("repo", "sha", "file", F.explode_outer("hunks").alias("hunk")).filter(F.col("hunk").isNotNull())

    def start(side: int) -> Column:
        named = F.regexp_extract("hunk", r"^@@ -([0-9]+)[0-9,]* \+([0-9]+)", side)
        return F.when(named == "", F.lit(1)).otherwise(named.cast("int"))

    lines = hunks.select("repo", "sha", "file", start(1).alias("old"), start(2).alias("new"),
                         F.split(F.regexp_replace("hunk", HUNK_HEADER, ""), "\n").alias("lines"))

    def side(sign: str, other: str, first: str) -> Column:
        own = F.filter("lines", lambda x: ~(x.startswith(other) | x.startswith("\\")))
        placed = F.transform(own, lambda x, i: F.struct((F.col(first) + i).alias("line_no"),
                                                        F.lit(sign).alias("sign"), x.alias("line")))
        return F.filter(placed, lambda x: x["line"].startswith(sign))

    return lines.select("repo", "sha", "file", side("+", "-", "new").alias("added"), side("-", "+", "old").alias("removed"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Added and removed lines of unified diffs: ``(repo, sha, file, line_no, sign, text)``."""
    changed = changed_hunks(diffs).select("repo", "sha", "file", F.concat("added", "removed").alias("changed"))
    return (changed.select("repo", "sha", "file", F.explode_outer("changed").alias("c"))
            .filter(F.col("c").isNotNull())
            .select("repo", "sha", "file", "c.line_no", "c.sign", F.substr("c.line", F.lit(2)).alias("text")))


def _placed(text: Column, detectors: Sequence[Detector]) -> Column:
    """Hits with ``start``, from 1: each is looked for behind the one before of its detector, so equal values differ."""
    def step(s: Column, h: Column) -> Column:
        start = F.call_function("locate", h["value"], text, F.when(s["of"] == h["detector"], s["next"]).otherwise(1))
        hit = F.struct(h["detector"].alias("detector"), h["pos"].alias("pos"), h["value"].alias("value"), start.alias("start"))
        return F.struct(h["detector"].alias("of"), (start + F.length(h["value"])).alias("next"), F.concat(s["hits"], F.array(hit)).alias("hits"))

    none = F.array().cast("array<struct<detector:string,pos:int,value:string,start:int>>")
    begin = F.struct(F.lit("").alias("of"), F.lit(1).alias("next"), none.alias("hits"))
    return F.aggregate(S.secret_hits(text, detectors), begin, step, lambda s: s["hits"])


def _units(diffs: DataFrame) -> DataFrame:
    """What detectors read: ``(repo, sha, file, line_no, sign, text, numbers)``.

    Each changed line is a row. So are all lines of one sign in a hunk, as one text, where
    a match could span them; ``numbers`` are then the numbers of its lines.
    """
    hints = [h for d in MULTI_LINE for h in d.hints]
    text_of = lambda x: F.substr(x["line"], F.lit(2))

    def whole(lines: str, sign: str) -> Column:
        unit = F.struct(F.lit(None).cast("int").alias("line_no"), F.lit(sign).alias("sign"),
                        F.array_join(F.transform(lines, text_of), "\n").alias("text"),
                        F.transform(lines, lambda x: x["line_no"]).alias("numbers"))
        spans = F.exists(lines, lambda x: reduce(lambda a, b: a | b, [x["line"].contains(h) for h in hints]))
        return F.when(spans, F.array(unit)).otherwise(F.array())

    single = F.transform(F.concat("added", "removed"), lambda x: F.struct(
        x["line_no"].alias("line_no"), x["sign"].alias("sign"), text_of(x).alias("text"), F.lit(None).cast("array<int>").alias("numbers")))
    units = changed_hunks(diffs).select("repo", "sha", "file", F.concat(single, whole("added", "+"), whole("removed", "-")).alias("units"))
    return (units.select("repo", "sha", "file", F.explode_outer("units").alias("u")).filter(F.col("u").isNotNull())
            .select("repo", "sha", "file", "u.*"))


def diff_added_lines(diffs: DataFrame) -> DataFrame:
    """Added lines only: ``(repo, sha, file, line_no, text)``."""
    return diff_lines(diffs).filter(F.col("sign") == "+").drop("sign")


def _hits(df: DataFrame, keys: Sequence[str], text: str, detectors: Sequence[Detector]) -> DataFrame:
    # Texts without any match never reach the generator.
    return (df.select(*keys, F.explode(S.secret_hits(F.col(text), detectors)).alias("_h"))
            .select(*keys, F.col("_h.detector").alias("detector"), F.col("_h.pos").alias("pos"),
                    F.col("_h.value").alias("_value")))


def detect_secrets(df: DataFrame, keys: Sequence[str], salt: str, text: str = "text",
                   detectors: Sequence[Detector] = DETECTORS,
                   min_entropy: float | None = None) -> DataFrame:
    """Findings ``(*keys, detector, pos, secret_redacted, secret_fp)``.

    Every row is read once for all detectors. ``min_entropy`` drops matches with
    fewer bits per character.
    """
    return _findings(_hits(df, keys, text, detectors), keys, salt, min_entropy)


def detect_in_diffs(diffs: DataFrame, salt: str, min_entropy: float | None = None) -> DataFrame:
    """Findings in the changed lines of diffs, those that span lines as a whole.

    What makes the diffs runs once: lines and hunks are read in one pass. A match
    that spans lines has the number of the line on which it begins.
    """
    keys = ["repo", "sha", "file", "line_no", "sign"]
    text, numbers = F.col("text"), F.col("numbers")
    hit = lambda h, line_no: F.struct(line_no.alias("line_no"), h["detector"].alias("detector"),
                                      h["pos"].alias("pos"), h["value"].alias("value"))
    first = lambda h: F.element_at(numbers, F.size(F.split(F.left(text, h["start"] - 1), "\n")))
    single = F.transform(S.secret_hits(text, [d for d in DETECTORS if d not in MULTI_LINE]), lambda h: hit(h, F.col("line_no")))
    spanning = F.transform(_placed(text, MULTI_LINE), lambda h: hit(h, first(h)))
    hits = _units(diffs).select("repo", "sha", "file", "sign", F.when(numbers.isNull(), single).otherwise(spanning).alias("hits"))
    rows = (hits.select("repo", "sha", "file", "sign", F.explode_outer("hits").alias("_h")).filter(F.col("_h").isNotNull())
            .select("repo", "sha", "file", "_h.line_no", "sign", "_h.detector", "_h.pos", F.col("_h.value").alias("_value")))
    return _findings(rows, keys, salt, min_entropy)


def _findings(hits: DataFrame, keys: Sequence[str], salt: str, min_entropy: float | None) -> DataFrame:
    if min_entropy is not None:
        hits = hits.filter(S.shannon_entropy(F.col("_value")) >= min_entropy)
    return hits.select(*keys, "detector", "pos",
                       S.redact_value(F.col("_value")).alias("secret_redacted"),
                       S.secret_fingerprint(F.col("_value"), salt).alias("secret_fp"))


def detect_with_entropy(df: DataFrame, keys: Sequence[str], salt: str, text: str = "text",
                        detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Findings with the entropy of each value."""
    return _hits(df, keys, text, detectors).select(
        *keys, "detector", "pos",
        F.round(S.shannon_entropy(F.col("_value")), 6).alias("entropy"),
        S.secret_fingerprint(F.col("_value"), salt).alias("secret_fp"))


def redact_documents(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, S.redact_text(F.col(text)))


def clean_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows without any finding, decided row by row instead of by an anti join."""
    return df.filter(~S.has_secret(F.col(text)))


def detector_catalog(df: DataFrame) -> DataFrame:
    """All detector names, as a small table."""
    names = DETECTOR_CATALOG + GENERIC_DETECTORS
    return df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("detector"))


def detector_coverage(findings: DataFrame) -> DataFrame:
    """Every catalogue name with its number of findings, zero included.

    Findings are counted before the join, so the join sees one row per detector.
    """
    counted = findings.groupBy("detector").agg(F.count("*").alias("n"))
    return (detector_catalog(findings).join(counted, "detector", "left")
            .select("detector", F.coalesce("n", F.lit(0)).alias("findings")))


def only_verified(findings: DataFrame) -> DataFrame:
    """Findings known to be live; unknown is not verified."""
    return findings.filter("verified")
