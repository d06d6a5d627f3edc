"""Messages and diffs for commits, by (repo, sha)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgate.functions.text import first_line

KEYS = ["repo", "sha"]


def resolve_messages(keyed: DataFrame, commits: DataFrame) -> DataFrame:
    """Every push with the first line of its message; pull requests keep their own.

    ``commits`` has one row per ``(repo, sha)``. Pushes without a message are
    left out. A commit pushed over and over makes a skewed partition of the push
    side, which adaptive execution splits.
    """
    known = commits.select(*KEYS, first_line(F.col("message")).alias("_text")) \
                   .filter(F.col("_text").isNotNull())
    pushes = (keyed.filter(~F.col("is_pr")).join(known, KEYS)
              .withColumn("message", F.col("_text")).drop("_text"))
    return pushes.unionByName(keyed.filter("is_pr"))


def unresolved_pushes(keyed: DataFrame, commits: DataFrame) -> DataFrame:
    known = commits.filter(first_line(F.col("message")).isNotNull()).select(*KEYS)
    return keyed.filter(~F.col("is_pr")).join(known, KEYS, "left_anti")


def attach_diffs(suspicious: DataFrame, diffs: DataFrame) -> DataFrame:
    """Diffs of suspicious commits, each commit once.

    Both sides are unique by key. The suspicious side grows with the data, so it
    is not broadcast by force; Spark filters the diff side early by a Bloom
    filter of the suspicious keys once the sizes warrant it.
    """
    wanted = suspicious.filter(F.size(F.split("repo", "/")) == 2).select(*KEYS).distinct()
    return diffs.join(wanted, KEYS).select(*KEYS, "diff")


def one_commit(diffs: DataFrame, repo: str | Column, sha: str | Column) -> DataFrame:
    """The diff of a single commit; the filter reaches the table scan."""
    return diffs.filter((F.col("repo") == repo) & (F.col("sha") == sha)).select(*KEYS, "diff")
