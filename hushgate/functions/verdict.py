"""Ordered message rules as one lazy CASE expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgate.functions.text import message_key
from hushgate.rules import (BROAD_NOUNS, BROAD_VERBS, HIGH_NOUNS, HIGH_VERBS, KEY_PREFIXES,
                            PATTERN_HINTS, REMOVAL_PATTERNS, SWEEP_PATTERNS, TOKEN_PATTERN)

WORD_SETS = {
    "high_verbs": HIGH_VERBS,
    "high_nouns": HIGH_NOUNS,
    "broad_verbs": BROAD_VERBS,
    "broad_nouns": BROAD_NOUNS,
}

# Outcome codes: 1-12 are the patterns in order.
BLANK, NONE, TIER1, TIER2 = -1, 0, 101, 102
SUSPICIOUS, CLEAN, AMBIGUOUS = "suspicious", "clean", "ambiguous"

# d: only \n ends a line; U: white space and word edges follow Unicode.
REGEX_FLAGS = "(?dU)"


PATTERNS = list(enumerate(zip(REMOVAL_PATTERNS + SWEEP_PATTERNS, PATTERN_HINTS), 1))


def pattern_found(key: Column, pattern: str, hints: Sequence[str]) -> Column:
    """Regex search behind plain byte searches, which rule out almost every message."""
    hinted = reduce(lambda a, b: a | b, [key.contains(h) for h in hints])
    return hinted & key.rlike(REGEX_FLAGS + pattern)


def _first_match(key: Column, patterns) -> Column:
    branch = F
    for rule_id, (pattern, hints) in patterns:
        branch = branch.when(pattern_found(key, pattern, hints), F.lit(rule_id))
    return branch


def match_removal_patterns(message: Column) -> Column:
    """Id 1-3 of the first removal pattern found, else null."""
    return _first_match(message_key(message), PATTERNS[:len(REMOVAL_PATTERNS)])


def match_sweep_patterns(message: Column) -> Column:
    """Id 4-12 of the first sweep pattern found, else null."""
    return _first_match(message_key(message), PATTERNS[len(REMOVAL_PATTERNS):])


def words_of(key: Column) -> Column:
    """Words of a message key, repeats kept."""
    return F.regexp_extract_all(key, F.lit(TOKEN_PATTERN), F.lit(0))


def tokenize(key: Column) -> Column:
    """Distinct words of a message key."""
    return F.array_distinct(words_of(key))


def _literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tier1(tokens: Column, sets: Mapping[str, Sequence[str]] = WORD_SETS) -> Column:
    return (F.arrays_overlap(tokens, _literals(sets["high_verbs"]))
            & F.arrays_overlap(tokens, _literals(sets["high_nouns"])))


def tier2(tokens: Column, sets: Mapping[str, Sequence[str]] = WORD_SETS) -> Column:
    return (F.arrays_overlap(tokens, _literals(sets["broad_verbs"]))
            & F.arrays_overlap(tokens, _literals(sets["broad_nouns"])))


def outcome_code(key: Column, words: Column, sets: Mapping[str, Sequence[str]] = WORD_SETS) -> Column:
    """Which rule decides a message key; everything else derives from this number."""
    branch = F.when(key == "", F.lit(BLANK))
    for rule_id, (pattern, hints) in PATTERNS:
        branch = branch.when(pattern_found(key, pattern, hints), F.lit(rule_id))
    return (branch.when(tier1(words, sets), F.lit(TIER1))
                  .when(tier2(words, sets), F.lit(TIER2))
                  .otherwise(F.lit(NONE)))


def tier_of(code: Column) -> Column:
    return (F.when(code == BLANK, F.lit("blank"))
             .when(code == NONE, F.lit("none"))
             .when(code == TIER1, F.lit("tier1"))
             .when(code == TIER2, F.lit("tier2"))
             .otherwise(F.lit("pattern")))


def rule_of(code: Column) -> Column:
    return F.when((code >= 1) & (code < TIER1), code)


def classification_of(code: Column) -> Column:
    return F.when(code > 0, F.lit(SUSPICIOUS)).otherwise(F.lit(CLEAN))


def single_reply_verdict(reply: Column) -> Column:
    """Classification out of one free-text reply; no reply leaves it open."""
    said_yes = F.lower(F.trim(reply)).startswith("true")
    return (F.when(reply.isNull(), F.lit(AMBIGUOUS))
             .when(said_yes, F.lit(SUSPICIOUS))
             .otherwise(F.lit(CLEAN)))


def credential_kind_by_prefix(value: Column, default: str = "openai") -> Column:
    """Label a key by its prefix, longest prefix first."""
    branch = F
    for prefix, kind in KEY_PREFIXES:
        branch = branch.when(value.startswith(prefix), F.lit(kind))
    return branch.otherwise(F.lit(default))
