"""Joining per-key results back to rows when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least this share of all rows, so there can be
# at most 1 / HOT_SHARE hot keys however large the data is.
HOT_SHARE = 1 / 1024
SALTS = 64


def with_counts(df: DataFrame, key: str) -> DataFrame:
    """One row per key with its row count ``n``; counts combine before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def join_back(df: DataFrame, counts: DataFrame, results: DataFrame, key: str, row_id: str,
              salts: int = SALTS, hot_share: float = HOT_SHARE) -> DataFrame:
    """Left join of ``results`` (one row per key, holding ``n``) to every row of ``df``.

    ``counts`` is ``with_counts(df, key)``. Rows of hot keys, and rows without a
    key, spread over ``salts`` partitions, and the result rows of hot keys are
    repeated once per salt. What is broadcast is one hash per hot key: at most
    ``1 / hot_share`` numbers, however long the keys are. Two keys with one hash
    are salted alike on both sides, which changes nothing in the result.
    """
    mark = F.xxhash64(key)
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    hot = F.broadcast(counts.filter(F.col("n") >= F.lit(hot_share) * total)
                      .select(mark.alias("_hot")).distinct())
    is_hot = F.col("_hot").isNotNull()
    salt = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    spread = (
        df.join(hot, mark == F.col("_hot"), "left")
        .withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    repeated = (
        results.drop("n").join(hot, mark == F.col("_hot"), "left")
        .withColumn("_last", F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0)))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .drop("_hot", "_last")
    )
    return spread.join(repeated, [key, "_salt"], "left").drop("_salt")
