"""Lists of the user's own mail domains."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgate.rules import DOMAIN_PATTERN, FREEMAIL_DOMAINS
from hushgate.sources.store import matching, remove, stage, write_bytes

COMPLETE, KEPT_VERSIONS = "_COMPLETE", 3


def extract_domains(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct sorted domains named in text lines, without free-mail hosts.

    Lines that hold the word ``domain`` are headings and are skipped.
    """
    line = F.lower(F.trim(F.col("line")))
    return (
        texts.select(F.explode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line"))
        .select(line.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").contains("domain"))
        .select(F.explode(F.regexp_extract_all("line", F.lit("(?U)" + DOMAIN_PATTERN), F.lit(1))).alias("domain"))
        .filter(~F.col("domain").isin(FREEMAIL_DOMAINS))
        .distinct()
        .orderBy("domain")
    )


def write_domain_list(domains: DataFrame, path: str, source: str) -> bool:
    """Store sorted distinct domains and their count; an empty list changes nothing.

    Domains are JSON lines rather than one array, so no task holds them all.
    Each list is a folder of its own whose mark is written last: readers take the
    newest marked one, so a write that fails halfway leaves the old list whole.
    Writers take turns; the last KEPT_VERSIONS lists stay for readers under way.
    """
    spark = domains.sparkSession
    rows = stage(domains.select("domain").distinct(), "domains")
    if rows.isEmpty():
        return False
    older = versions(spark, path, complete=False)
    version = f"{path}/v{max(older, default=0) + 1:08d}"
    rows.orderBy("domain").write.json(f"{version}/domains")
    (rows.agg(F.count("*").alias("count")).select(F.lit(source).alias("source"), "count")
     .write.json(f"{version}/summary"))
    write_bytes(spark, f"{version}/{COMPLETE}", b"")
    for old in older[:1 - KEPT_VERSIONS]:
        remove(spark, f"{path}/v{old:08d}")
    return True


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """Numbers of the stored versions in order, by default of those written to the end."""
    found = matching(spark, f"{path}/v*/{COMPLETE}" if complete else f"{path}/v*")
    return sorted(int(re.search(r"/v(\d{8})(?:/|$)", p).group(1)) for p in found if re.search(r"/v\d{8}(?:/|$)", p))


def _newest(spark: SparkSession, path: str) -> str:
    done = versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no complete domain list in {path}")
    return f"{path}/v{done[-1]:08d}"


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string").json(f"{_newest(spark, path)}/domains")


def read_domain_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, count bigint").json(f"{_newest(spark, path)}/summary")


def read_domain_document(spark: SparkSession, path: str) -> DataFrame:
    """Domains of a single JSON document ``{source, count, domains: [...]}``."""
    return (spark.read.schema("domains array<string>").option("multiLine", True).json(path)
            .select(F.explode("domains").alias("domain")))


def union_domain_lists(*lists: DataFrame) -> DataFrame:
    merged = lists[0].select("domain")
    for more in lists[1:]:
        merged = merged.unionByName(more.select("domain"))
    return merged.select(F.lower(F.trim("domain")).alias("domain")).distinct()
