"""Prompts for, and answers from, a reviewer outside of Spark; secrets in messages are masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushgate.functions import verdict as V
from hushgate.functions.secrets import redact_text
from hushgate.rules import REVIEW_BATCH_PROMPT, REVIEW_PROMPT
from hushgate.sources.store import stage

FENCES = r"^\s*```(?:json)?\s*|\s*```\s*$"


def build_review_prompt(messages: DataFrame, message: str = "message",
                        template: str = REVIEW_PROMPT) -> DataFrame:
    return messages.withColumn(
        "prompt", F.replace(F.lit(template), F.lit("{commit_message}"), redact_text(F.col(message))))


def number_for_review(keys: DataFrame, key: str = "message_key", size: int = 50,
                      buckets: int = 256) -> DataFrame:
    """Gives each distinct message a batch and an index that starts at 0 in each batch.

    Messages hash into buckets that are numbered independently, so there is no
    global numbering in a single task; a batch never exceeds ``size``.
    """
    bucket = F.pmod(F.conv(F.left(F.md5(F.col(key)), F.lit(8)), 16, 10).cast("bigint"), F.lit(buckets))
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (keys.select(key).distinct()
            .withColumn("_bucket", bucket)
            .withColumn("_pos", position)
            .select(F.format_string("%d-%d", "_bucket", F.floor(F.col("_pos") / size).cast("bigint"))
                    .alias("batch_id"),
                    (F.col("_pos") % size).cast("int").alias("idx"), key))


def number_in_full_batches(keys: DataFrame, key: str = "message_key", size: int = 50, per_bucket: int = 1 << 16) -> DataFrame:
    """The same with every batch full but for the last, and as many buckets as the messages fill.

    Two passes: messages are numbered within hash buckets of about ``per_bucket``
    rows, then each bucket starts where the counts of those before it end. Only
    one count for each bucket is ever put in one order.
    """
    rows = stage(keys.select(key).distinct(), "review-keys")
    buckets = max(1, -(-rows.count() // per_bucket))
    hashed = rows.withColumn("_bucket", F.pmod(F.conv(F.left(F.md5(F.col(key)), F.lit(8)), 16, 10).cast("bigint"), F.lit(buckets)))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (hashed.join(starts, "_bucket").withColumn("_number", number)
            .select(F.floor(F.col("_number") / size).cast("string").alias("batch_id"), (F.col("_number") % size).cast("int").alias("idx"), key))


def build_review_batches(numbered: DataFrame, key: str = "message_key",
                         template: str = REVIEW_BATCH_PROMPT) -> DataFrame:
    """One prompt per batch; a batch holds a bounded number of messages."""
    entry = F.format_string("[%d] %s", F.col("idx"), redact_text(F.col(key)))
    ordered = F.array_sort(F.collect_list(F.struct("idx", entry.alias("entry"))))
    body = F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n---\n")
    return (numbered.groupBy("batch_id")
            .agg(F.count("*").alias("messages"), body.alias("body"))
            .withColumn("prompt", F.replace(F.lit(template), F.lit("{messages}"), F.col("body"))))


def parse_review_verdicts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per ``(batch_id, idx)`` answered with a boolean; bad replies give none."""
    answers = F.from_json(F.regexp_replace(F.col(reply), FENCES, ""), "map<string,string>")
    return (replies.select("batch_id", F.explode(answers).alias("_idx", "_said"))
            .select("batch_id", F.col("_idx").try_cast("int").alias("idx"),
                    F.when(F.col("_said") == "true", F.lit(True))
                     .when(F.col("_said") == "false", F.lit(False)).alias("leak_fix"))
            .filter(F.col("idx").isNotNull() & F.col("leak_fix").isNotNull()))


def apply_review_verdicts(numbered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Classification of each numbered message; no answer means clean."""
    said_yes = F.coalesce("leak_fix", F.lit(False))
    return (numbered.join(verdicts, ["batch_id", "idx"], "left")
            .withColumn("classification",
                        F.when(said_yes, F.lit(V.SUSPICIOUS)).otherwise(F.lit(V.CLEAN)))
            .drop("leak_fix"))


def apply_single_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    return df.withColumn("classification", V.single_reply_verdict(F.col(reply)))
