"""Classification of commit messages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.functions import verdict as V
from hushgate.functions.text import message_key
from hushgate.operators.skew import join_back, with_counts

CODE = "_code"
KEY = "message_key"
ASKED = "_asked"


def with_code(df: DataFrame, message: str = "message",
              sets: Mapping[str, Sequence[str]] = V.WORD_SETS) -> DataFrame:
    """Adds the message key and the code of the rule that decides it."""
    return _coded(df.withColumn(KEY, message_key(F.col(message))), sets)


def _coded(keyed: DataFrame, sets: Mapping[str, Sequence[str]] = V.WORD_SETS) -> DataFrame:
    # A later filter on the outcome would be pushed below the projection with the
    # whole rule chain copied into it. It cannot pass a generator, so each message
    # runs through the chain once.
    code = V.outcome_code(F.col(KEY), F.col("_words"), sets)
    return (keyed.withColumn("_words", V.words_of(F.col(KEY)))
            .withColumn(CODE, F.explode(F.array(code))).drop("_words"))


def _labelled(df: DataFrame) -> DataFrame:
    code = F.col(CODE)
    return (df.withColumn("classification", V.classification_of(code))
              .withColumn("tier", V.tier_of(code))
              .withColumn("rule_id", V.rule_of(code))
              .drop(CODE))


def classify(df: DataFrame, message: str = "message",
             sets: Mapping[str, Sequence[str]] = V.WORD_SETS) -> DataFrame:
    """Adds ``classification``, ``tier`` and ``rule_id``. Narrow: no shuffle, no UDF."""
    return _labelled(with_code(df, message, sets)).drop(KEY)


def classify_with_rules(df: DataFrame, rules: DataFrame | Mapping[str, Sequence[str]],
                        message: str = "message", row_id: str = "event_id") -> DataFrame:
    """Classify with the caller's own words instead of the built-in ones.

    A mapping becomes literals. A table ``(word_set, word)`` of any size is
    joined with the words of the distinct messages, and the outcome of a message
    is joined back to its rows.
    """
    if not isinstance(rules, DataFrame):
        return classify(df, message, {**{name: [] for name in V.WORD_SETS}, **rules})
    keyed = df.withColumn(KEY, message_key(F.col(message)))
    counts = with_counts(keyed, KEY)
    words = (counts.select(KEY, F.explode(V.tokenize(F.col(KEY))).alias("word"))
             .join(rules.select("word_set", "word").distinct(), "word"))
    has = {name: F.coalesce(F.bool_or(F.col("word_set") == name), F.lit(False)) for name in V.WORD_SETS}
    per_key = words.groupBy(KEY).agg(
        (has["high_verbs"] & has["high_nouns"]).alias("_t1"),
        (has["broad_verbs"] & has["broad_nouns"]).alias("_t2"))
    joined = join_back(keyed, counts, per_key, KEY, row_id)
    undecided = F.col(CODE) == V.NONE
    coded = _coded(joined, {name: [] for name in V.WORD_SETS}).withColumn(
        CODE, F.when(undecided & F.coalesce("_t1", F.lit(False)), F.lit(V.TIER1))
               .when(undecided & F.coalesce("_t2", F.lit(False)), F.lit(V.TIER2))
               .otherwise(F.col(CODE)))
    return _labelled(coded).drop(KEY, "_t1", "_t2")


# ---- plug-in scorers -----------------------------------------------------

Scorer = Callable[[pd.Series], pd.Series]

_scorers: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Register a second stage: a batch of message keys in, booleans (or null) out."""
    _scorers[name.lower()] = scorer


def score_unresolved(df: DataFrame, scorer: str | None, message: str = "message",
                     row_id: str = "event_id") -> DataFrame:
    """Classify, then ask a scorer about the messages that no rule decides.

    Each distinct undecided message is scored once. An unknown scorer name
    switches the stage off; a message without an answer counts as clean.
    """
    fn = _scorers.get((scorer or "").lower())
    coded = with_code(df, message)
    if fn is None:
        return _labelled(coded).drop(KEY)
    asked = coded.withColumn(ASKED, F.when(F.col(CODE) == V.NONE, F.col(KEY)))
    counts = with_counts(asked.filter(F.col(ASKED).isNotNull()), ASKED)
    verdicts = counts.withColumn("_verdict", F.pandas_udf(fn, "boolean")(F.col(ASKED)))
    # Decided rows need no answer and are not shuffled.
    decided = asked.filter(F.col(ASKED).isNull()).withColumn("_verdict", F.lit(None).cast("boolean"))
    open_rows = join_back(asked.filter(F.col(ASKED).isNotNull()), counts, verdicts, ASKED, row_id)
    answered = _labelled(open_rows.unionByName(decided))
    undecided = F.col(ASKED).isNotNull()
    return (answered
            .withColumn("classification",
                        F.when(undecided & F.coalesce("_verdict", F.lit(False)), F.lit(V.SUSPICIOUS))
                         .otherwise(F.col("classification")))
            .withColumn("tier", F.when(undecided, F.lit("model")).otherwise(F.col("tier")))
            .drop(ASKED, KEY, "_verdict"))


def classify_batch(df: DataFrame, message: str = "message", scorer: str | None = None,
                   row_id: str = "event_id") -> DataFrame:
    """One classification per input row.

    Rules are plain expressions, cheaper to evaluate on every row than to
    shuffle rows for; only the scorer runs on distinct messages.
    """
    return score_unresolved(df, scorer, message, row_id) if scorer else classify(df, message)


def classifier_stats(df: DataFrame, message: str = "message", model_calls: bool = False) -> DataFrame:
    """One row of counters: distinct messages decided per stage, and repeats."""
    keyed = df.select(message_key(F.col(message)).alias(KEY)).filter(F.col(KEY) != "")
    coded = _coded(with_counts(keyed, KEY))
    tier = V.tier_of(F.col(CODE))
    open_count = F.count_if(tier == "none") if model_calls else F.lit(0).cast("bigint")
    return coded.withColumn("tier", tier).agg(
        F.count_if(F.col("tier") == "pattern").alias("patterns"),
        F.count_if(F.col("tier") == "tier1").alias("regex_tier1"),
        F.count_if(F.col("tier") == "tier2").alias("regex_tier2"),
        open_count.alias("llm"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("cache_hit"))


def suspicious_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("classification") == V.SUSPICIOUS)
