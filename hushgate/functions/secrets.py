"""Detection, redaction and fingerprints of credential-shaped text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgate.functions.text import or_empty
from hushgate.rules import DETECTORS, MASK, Detector

HITS = "array<struct<detector:string,pos:int,value:string>>"


def _hinted(text: Column, d: Detector) -> Column:
    """A plain byte search that every match of the detector must pass."""
    return reduce(lambda a, b: a | b, [text.contains(h) for h in d.hints]) if d.hints else text.isNotNull()


def secret_hits(text: Column, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """All matches of all detectors in one pass over a row.

    Elements hold the raw value, so this stays inside operators that turn it
    into a fingerprint before anything leaves them.
    """
    def found(d: Detector) -> Column:
        values = F.regexp_extract_all(text, F.lit(d.pattern), F.lit(1))
        rows = F.transform(values, lambda v, i: F.struct(
            F.lit(d.name).alias("detector"), i.alias("pos"), v.alias("value")))
        return F.when(_hinted(text, d), rows).otherwise(F.array().cast(HITS))

    return F.concat(*[found(d) for d in detectors])


def has_secret(text: Column, detectors: Sequence[Detector] = DETECTORS) -> Column:
    tests = [_hinted(text, d) & text.rlike(d.pattern) for d in detectors]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def redact_text(text: Column, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """Text with every detected value masked and its surroundings kept.

    Only texts that hold a secret go through the replacements.
    """
    masked = text
    for d in detectors:
        masked = F.regexp_replace(masked, d.replacing, "$1" + MASK + "$2")
    return F.when(has_secret(text, detectors), masked).otherwise(text)


def secret_fingerprint(value: Column, salt: str | Column) -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(salt, value), 256)


def redact_value(value: Column) -> Column:
    """At most four characters and a quarter of the value; nothing of values under 12 characters."""
    n = F.length(or_empty(value))
    shown = F.when(n < 12, F.lit(0)).otherwise(F.least(F.lit(4), F.floor(n / 4))).cast("int")
    return F.concat(F.left(or_empty(value), shown), F.lit("..."))


def shannon_entropy(value: Column) -> Column:
    """Bits per character."""
    n = F.length(value).cast("double")
    chars = F.array_distinct(F.split(value, "", -1))

    def share(c: Column) -> Column:
        return (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n

    shares = F.transform(F.filter(chars, lambda c: c != ""), share)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
