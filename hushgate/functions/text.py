"""Text helpers: Column -> Column, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgate.rules import BLANKS


def or_empty(c: Column) -> Column:
    """Missing text is the empty string, never null."""
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_line(message: Column) -> Column:
    """Text before the first newline; null when there is none."""
    return null_if_empty(F.substring_index(message, "\n", 1))


def message_key(message: Column) -> Column:
    """Trimmed, lower-cased message: what rules match and what repeats share."""
    return F.lower(F.btrim(or_empty(message), F.lit(BLANKS)))


def short_sha(sha: Column) -> Column:
    return F.left(sha, F.lit(12))


def truncate_ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def shorten_words(text: Column, width: int = 60) -> Column:
    """One-line text cut at a blank so that it fits ``width`` with its dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_extract(flat, rf"^(.{{0,{width - 3}}})(\s|$)", 1)
    return F.when(F.length(flat) > width, F.concat(cut, F.lit("..."))).otherwise(flat)


def dash_if_empty(text: Column) -> Column:
    return F.coalesce(null_if_empty(text), F.lit("—"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def unescape_basic(html: Column) -> Column:
    """Undo the five basic entities, the ampersand last."""
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def email_domain(email: Column) -> Column:
    """Lower-cased text after the last ``@``; empty when there is no ``@``."""
    e = or_empty(email)
    return F.when(e.contains("@"), F.lower(F.substring_index(F.btrim(e, F.lit(BLANKS)), "@", -1))) \
            .otherwise(F.lit(""))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def finding_label(verified: Column, detector: Column, file: Column, commit: Column) -> Column:
    state = F.when(F.coalesce(verified, F.lit(False)), F.lit("VERIFIED")).otherwise(F.lit("unverified"))
    return F.format_string("[%s] %s in %s @ %s", state, or_empty(detector), or_empty(file),
                           short_sha(or_empty(commit)))


def run_duration(start: Column, end: Column) -> Column:
    """Whole seconds as text; ``running`` without an end, ``unknown`` without a start."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return (F.when(start.isNull(), F.lit("unknown"))
             .when(end.isNull(), F.lit("running"))
             .otherwise(F.concat(seconds.cast("string"), F.lit("s"))))
