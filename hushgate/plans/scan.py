"""The whole run: archive events to findings."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.functions.forge import repo_url_parts
from hushgate.functions.secrets import has_secret
from hushgate.functions.text import first_line
from hushgate.operators import events as E
from hushgate.operators.attribute import Owned, attribute_events, owned_only
from hushgate.operators.classify import classify, classify_batch, suspicious_only
from hushgate.operators.detect import detect_in_diffs
from hushgate.operators.resolve import attach_diffs, one_commit, resolve_messages
from hushgate.sources.archive import in_hours
from hushgate.sources.store import read_by_hour


class Scan(NamedTuple):
    classified: DataFrame
    findings: DataFrame | None


def commit_events(raw: DataFrame, owned: tuple[Owned, Owned] | None = None) -> DataFrame:
    """Commit rows of raw events, narrowed to owned ones first when asked to."""
    if owned:
        raw = owned_only(attribute_events(raw, *owned))
    return E.keyed_events(raw)


def classify_events(raw: DataFrame, commits: DataFrame, *,
                    owned: tuple[Owned, Owned] | None = None,
                    fraction: float | None = None, scorer: str | None = None) -> DataFrame:
    keyed = commit_events(raw, owned)
    if fraction is not None:
        # Before the lookup, as sampling is what makes the lookup cheaper.
        keyed = E.sample_commits(keyed, fraction)
    return classify_batch(resolve_messages(keyed, commits), scorer=scorer)


def scan_diffs(diffs: DataFrame, salt: str, min_entropy: float | None = None) -> DataFrame:
    """Findings in the changed lines of diffs.

    Removed lines count too: a commit that cleans up a leak shows the value there.
    Whatever matches in a line matches in its diff, as does the first line of a
    private key, so diffs without any match are dropped first. Spark moves that test below the join that attaches the
    diffs: only diffs that hold something are shuffled and taken apart.
    """
    holding = diffs.filter(has_secret(F.col("diff")))
    return detect_in_diffs(holding, salt, min_entropy)


def scan_hours(raw: DataFrame, commits: DataFrame, diffs_path: str, salt: str, start: str, end: str, *,
               look_back: int = 24, owned: tuple[Owned, Owned] | None = None, scorer: str | None = None) -> Scan:
    """A scan of the hours ``[start, end)``, written ``yyyy-MM-dd-HH``, over diffs stored by hour.

    ``diffs_path`` is what ``write_by_hour`` wrote, each diff under the hour in which
    it was stored. Only folders from ``look_back`` hours before the start are read,
    whatever the table has grown to.
    """
    first, last = (datetime.strptime(h, "%Y-%m-%d-%H") for h in (start, end))
    at = lambda t: F.lit(t.isoformat(" ")).cast("timestamp_ntz")
    keyed = in_hours(commit_events(raw, owned), at(first), at(last))
    classified = classify_batch(resolve_messages(keyed, commits), scorer=scorer)
    early = (first - timedelta(hours=look_back)).strftime("%Y-%m-%d-%H")
    diffs = read_by_hour(raw.sparkSession, diffs_path, early, end).select("repo", "sha", "diff")
    return Scan(classified, scan_diffs(attach_diffs(suspicious_only(classified), diffs), salt))


def scan_one(url: str, sha: str, commits: DataFrame, diffs: DataFrame, salt: str) -> Scan:
    """The classified message and the findings of one commit, named by the address of its repository.

    The address is a constant, so the filters on repository and commit reach the scans.
    An address without owner and name gives nothing.
    """
    parts = repo_url_parts(F.lit(url))
    repo = F.concat(parts["owner"], F.lit("/"), parts["repo"])
    named = (parts["owner"] != "") & (parts["repo"] != "")
    one = commits.filter(named & (F.col("repo") == repo) & (F.col("sha") == sha))
    classified = classify(one.select("repo", "sha", first_line(F.col("message")).alias("message")))
    return Scan(classified, scan_diffs(one_commit(diffs.filter(named), repo, sha), salt))


def scan(raw: DataFrame, commits: DataFrame, diffs: DataFrame, salt: str, *,
         owned: tuple[Owned, Owned] | None = None, fraction: float | None = None,
         scorer: str | None = None, max_commits: int | None = None,
         skip_diffs: bool = False) -> Scan:
    """Classified commits, and findings in the diffs of the suspicious ones."""
    classified = classify_events(raw, commits, owned=owned, fraction=fraction, scorer=scorer)
    if skip_diffs:
        return Scan(classified, None)
    suspicious = suspicious_only(classified)
    if max_commits:
        suspicious = E.max_commits(suspicious, max_commits)
    return Scan(classified, scan_diffs(attach_diffs(suspicious, diffs), salt))
