"""Scanner output as findings, and findings as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.functions.secrets import redact_value, secret_fingerprint
from hushgate.functions.text import or_empty
from hushgate.schemas import FINDING_COLUMNS

CSV_COLUMNS = ["detector", "verified", "commit", "file", "repository", "email"]


def parse_findings(lines: DataFrame, salt: str, line: str = "value") -> DataFrame:
    """Typed findings out of scanner JSON lines; blank and broken lines are skipped.

    A line is parsed once into a variant. Paths are case-sensitive, which keeps
    the two spellings of the git section apart. The raw value is replaced by
    its fingerprint before the row leaves this function.
    """
    doc = F.col("doc")

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(doc, path, kind)

    def git(field: str) -> Column:
        return F.coalesce(*[at(f"$.SourceMetadata{wrap}.{name}.{field}")
                            for wrap in (".Data", "") for name in ("Git", "git")])

    def filesystem(field: str) -> Column:
        return F.coalesce(at(f"$.SourceMetadata.Data.filesystem.{field}"),
                          at(f"$.SourceMetadata.filesystem.{field}"))

    raw = or_empty(F.coalesce(at("$.Data.RawV2"), at("$.RawV2")))
    text = F.trim(F.col(line))
    return (
        lines
        .filter(text.startswith("{"))
        .select(F.try_parse_json(text).alias("doc"))
        .filter(doc.isNotNull())
        .select(
            or_empty(at("$.DetectorName")).alias("detector"),
            or_empty(at("$.DetectorType")).alias("detector_type"),
            or_empty(at("$.DecoderName")).alias("decoder"),
            F.coalesce(at("$.Verified", "boolean"), F.lit(False)).alias("verified"),
            (~or_empty(at("$.Redacted")).isin("", "false")).alias("redacted"),
            F.when(raw == "", F.lit("")).otherwise(redact_value(raw)).alias("secret_redacted"),
            F.when(raw == "", F.lit("")).otherwise(secret_fingerprint(raw, salt)).alias("secret_fp"),
            or_empty(git("commit")).alias("commit"),
            or_empty(F.coalesce(git("file"), filesystem("file"))).alias("file"),
            or_empty(git("email")).alias("email"),
            or_empty(git("timestamp")).alias("timestamp"),
            or_empty(git("repository")).alias("repository"),
            or_empty(git("committer")).alias("committer"),
        )
        .select(*FINDING_COLUMNS)
    )


def read_findings(spark: SparkSession, paths: str | list[str], salt: str) -> DataFrame:
    return parse_findings(spark.read.text(paths), salt)


def findings_csv(findings: DataFrame) -> DataFrame:
    return findings.select(*CSV_COLUMNS)


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings_csv(findings).write.mode("overwrite").option("header", True).csv(path)


def read_findings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Findings saved as CSV; empty fields come back as empty text."""
    schema = ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in CSV_COLUMNS)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[F.col(c) if c == "verified" else or_empty(F.col(c)).alias(c) for c in CSV_COLUMNS])
