import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushgate.functions import verdict as V
from hushgate.operators import classify as C
from hushgate.operators import review as W
from hushgate.operators import skew
from hushgate.rules import PATTERN_HINTS, REMOVAL_PATTERNS, SWEEP_PATTERNS

VECTORS = [
    ("remove leaked api key", "pattern", 1), ("fix: expose secret token", "pattern", 2),
    ("revoke aws credentials", "tier1", None), ("remove hard coded api key from config", "pattern", 1),
    ("security fix: remove hardcoded credentials", "pattern", 4), ("rotate database password", "pattern", 1),
    ("replace actual api key placeholder", "pattern", 9), ("this is not a real key", "pattern", 8),
    ("credentials leak fixed", "pattern", 11), ("update readme", "none", None),
    ("fix keyboard shortcut", "none", None), ("chore: clean up env file", "none", None),
    ("add new feature", "none", None),
]

EDGES = [
    ("expose credentials.", "none", None), ("remove config.env", "none", None), ("remove old\nkey", "tier2", None),
    ("remove api-key", "pattern", 1), ("\tUpdate Docker\n", "tier2", None), ("", "blank", None),
    ("  \n", "blank", None), (None, "blank", None), ("delete credentials", "tier1", None),
    ("remove old\u2028key", "pattern", 1), ("\u00e9remove key", "tier2", None), ("remove\u00a0coded", "pattern", 4),
    ("REVERT this for SECURITY reasons", "pattern", 3), ("rm .env", "pattern", 5), ("rm  x.env", "none", None),
    ("commit by mistake", "pattern", 7), ("secret exposed", "pattern", 12), ("rotate all api keys", "pattern", 6),
]


def _outcome(spark, strings, messages):
    rows = C.classify(strings(messages, "message")).orderBy("i").collect()
    return [(r.tier, r.rule_id, r.classification) for r in rows]


def test_known_vectors_and_edges(spark, strings):
    cases = VECTORS + EDGES
    got = _outcome(spark, strings, [m for m, _, _ in cases])
    want = [(t, r, "clean" if t in ("none", "blank") else "suspicious") for _, t, r in cases]
    assert got == want


def test_hints_never_hide_a_match(spark, strings):
    messages = [m or "" for m, _, _ in VECTORS + EDGES] + [
        "delete the token", "patch compromise", "pushed mistake", "this is not real", "replace your x",
        "a security  fix", "credential leaks", "secret in code", "hard-coded", "remove hard-coded x"]
    keyed = strings(messages, "m").select(F.lower(F.trim("m")).alias("k"))
    for pattern, hints in zip(REMOVAL_PATTERNS + SWEEP_PATTERNS, PATTERN_HINTS, strict=True):
        plain = F.col("k").rlike(V.REGEX_FLAGS + pattern)
        assert keyed.filter(plain != V.pattern_found(F.col("k"), pattern, hints)).count() == 0


def test_each_message_runs_through_the_rules_once(spark, strings):
    df = C.suspicious_only(C.classify(strings(["remove key"], "message")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hard[-") == 1


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows share one message, the rest are all different."""
    return spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 > 0, "nothing here").otherwise(F.concat(F.lit("note "), "id")).alias("message"))


def test_scorer_sees_each_message_once_and_rows_stay_whole(spark, skewed):
    seen = spark.sparkContext.accumulator(0)

    def scorer(keys: pd.Series) -> pd.Series:
        seen.add(len(keys))
        return keys.str.endswith("0")

    C.register_scorer("ends", scorer)
    rows = skewed.union(spark.createDataFrame([(9000, "remove key"), (9001, "")], skewed.schema))
    got = {r.event_id: (r.classification, r.tier) for r in C.score_unresolved(rows, "ENDS").collect()}
    assert len(got) == 3002 and seen.value == 1001
    assert got[0] == ("suspicious", "model") and got[3] == ("clean", "model") and got[1] == ("clean", "model")
    assert got[9000] == ("suspicious", "pattern") and got[9001] == ("clean", "blank")


def test_unknown_scorer_is_off(spark, skewed):
    assert C.score_unresolved(skewed, "no such").filter("tier = 'model'").count() == 0


def test_join_back_spreads_hot_keys_and_keeps_all_rows(spark, skewed):
    counts = skew.with_counts(skewed, "message")
    results = counts.withColumn("size", F.length("message"))
    out = skew.join_back(skewed, counts, results, "message", "event_id", salts=8)
    assert out.count() == 3000
    assert out.filter(F.col("size") != F.length("message")).count() == 0
    # Only the hot key is repeated, so the lookup side grows by the number of salts.
    hot = counts.filter(F.col("n") > 100).count()
    assert hot == 1


def test_rule_table_equals_rule_mapping(spark, strings):
    words = {"high_verbs": ["drop"], "high_nouns": ["oven"], "broad_verbs": ["heat"], "broad_nouns": ["pan", "pot"]}
    table = spark.createDataFrame([(s, w) for s, ws in words.items() for w in ws], "word_set string, word string")
    df = strings(["drop oven", "heat the pot", "heat oven", "remove api key", "", None, "pan"], "message") \
        .withColumnRenamed("i", "event_id")
    key = ["event_id", "tier", "classification"]
    a = C.classify_with_rules(df, words).select(*key).orderBy("event_id").collect()
    b = C.classify_with_rules(df, table).select(*key).orderBy("event_id").collect()
    assert a == b and [r.tier for r in a] == ["tier1", "tier2", "none", "pattern", "blank", "blank", "none"]


def test_stats_count_messages_once_and_repeats_as_hits(spark, strings):
    df = strings(["remove key", " Remove KEY ", "update docker", "delete credentials", "hi", "hi", "hi", "", None], "message")
    row = C.classifier_stats(df, model_calls=True).first()
    assert row.asDict() == {"patterns": 1, "regex_tier1": 1, "regex_tier2": 1, "llm": 1, "cache_hit": 3}


def test_review_batches_are_bounded_and_complete(spark):
    keys = spark.range(237).select(F.concat(F.lit("m"), "id").alias("message_key"))
    numbered = W.number_for_review(keys, size=10, buckets=4)
    per = numbered.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b"))
    assert per.filter("n > 10 OR a <> 0 OR b <> n - 1").count() == 0
    assert numbered.select("message_key").distinct().count() == 237
    first = W.build_review_batches(numbered).first()
    assert "[0] m" in first.prompt and first.prompt.count("\n---\n") == first.messages - 1


def test_replies(spark):
    replies = spark.createDataFrame([
        ("a", '```json\n{"0": true, "1": false, "z": true, "2": "maybe"}\n```'), ("b", "oops"), ("c", None), ("d", "[1]"),
    ], "batch_id string, reply string")
    got = sorted(map(tuple, W.parse_review_verdicts(replies).collect()))
    assert got == [("a", 0, True), ("a", 1, False)]
    single = spark.createDataFrame([(0, " TRUE."), (1, "no"), (2, None)], "i int, reply string")
    assert [r.classification for r in W.apply_single_replies(single).orderBy("i").collect()] == [
        "suspicious", "clean", "ambiguous"]
