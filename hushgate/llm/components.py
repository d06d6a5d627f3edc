"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import stage


def _star(edges: DataFrame) -> DataFrame:
    """One small-star over ``(hi, lo)`` edges after one large-star; the result has the same components."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = both.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.filter("v > u").join(least, "u").filter("v <> m")
             .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
    lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = (large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
             .unionByName(lowest.select("hi", F.col("m").alias("lo"))))
    return small.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another one; the component is its least node.

    Rounds work on edges only, by aggregates whose copies combine before the
    shuffle and joins that adaptive execution can split, so a node with very
    many neighbours is no problem. Null ends and loops are no edges. Each
    round is written to the shared folder; two sums decide when to stop.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = stage(pairs, "edges"), None
    for _ in range(most_rounds):
        after = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
        if not after[0]:
            break
        now = stage(_star(now), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
