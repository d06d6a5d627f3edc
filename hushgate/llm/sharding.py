"""Shards of near-equal size by sampled splitters.

Rows are ordered by a hash of their text, so equal texts lie together. A
size-weighted sample of these keys gives quantile boundaries for many fine
ranges; the exact bytes and rows of each range are then counted, ranges that
came out overfull are sampled and cut again until none is, and consecutive
ranges fill the shards. What one row holds cannot be cut and does not count. A range that holds a single text is cut by row, so one text may fill
several shards; all other equal texts share one.

Defined results: a null text counts one byte and shares its key with other
nulls; null or repeated keys are ordinary rows; an empty table gives no rows;
columns besides key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushgate.llm.common import stage, utf8_bytes

#: Fine ranges for each shard; a shard's size is off by about one of them.
RANGES_PER_SHARD = 256
#: Sampled keys for each range. With the number of ranges this bounds what the driver sees.
SAMPLES_PER_RANGE = 4
#: A range is cut again if it holds more than so many times its share.
OVERFULL = 2.0
#: A single text is cut only if it holds more than so much of a shard.
SPLIT_TEXT = 0.03
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def locate(h: np.ndarray, tie: np.ndarray, cut_h: np.ndarray, cut_tie: np.ndarray) -> np.ndarray:
    """Number of cuts ``(h, tie)`` at or below each key, both in lexical order."""
    low, high = np.searchsorted(cut_h, h, "left"), np.searchsorted(cut_h, h, "right")
    out = low.copy()
    for a in np.unique(low[high > low]):
        at = (low == a) & (high > low)
        b = high[at][0]
        out[at] = a + np.searchsorted(cut_tie[a:b], tie[at], "right")
    return out


def _ranged(keys: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    cut_h, cut_tie = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
    schema = "id long, size long, crc long, h long, tie long, range int"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, tie = b.column("h").to_numpy(), b.column("tie").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(locate(h, tie, cut_h, cut_tie), pa.int32())],
                                             names=[*b.schema.names, "range"])

    return keys.mapInArrow(assign, schema)


def _sampled_cuts(rows: DataFrame, weight, cut_by: str, per_range: dict[int, tuple[float, int]], seed: int) -> list:
    """Quantile cuts inside ranges. ``per_range``: its weight and the number of parts wanted."""
    if not per_range:
        return []
    spark = rows.sparkSession
    want = spark.createDataFrame([(r, n * SAMPLES_PER_RANGE / w) for r, (w, n) in per_range.items()], "range int, rate double")
    u = F.shiftrightunsigned(F.xxhash64("h", "tie", F.lit(seed)), 11) / F.lit(float(1 << 53))
    picked = (rows.join(F.broadcast(want), "range").withColumn("w", weight)
              .filter(u < F.col("w") * F.col("rate"))
              .select("range", "h", "tie", F.greatest(F.col("w"), 1 / F.col("rate")).alias("w")).toPandas())
    cuts = []
    for r, part in picked.groupby("range"):
        part = part.sort_values(["h", "tie"])
        share = part["w"].cumsum() / part["w"].sum() * per_range[int(r)][1]
        first = part[np.floor(share).diff().fillna(0) > 0]
        cuts += [(int(h), int(t) if cut_by == "tie" else FIRST) for h, t in zip(first["h"], first["tie"])]
        if cut_by == "h":  # a text that fills a range of its own also ends there
            cuts += [(int(h) + 1, FIRST) for h in first["h"][first["h"].duplicated()].unique() if h < LAST]
    return cuts


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", most_rounds: int = 40) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` with near-equal bytes in each shard and slots without gaps from 0."""
    keys = stage(docs.select(
        F.col(key).cast("long").alias("id"), (utf8_bytes(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("crc"), F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("tie")), "shard-keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    weight = F.col("size") / F.lit(max(total, 1) * 2.0) + F.lit(0.5 / max(n, 1))
    ranges = min(shards * RANGES_PER_SHARD, max(n, 1))
    cuts = _sampled_cuts(keys.withColumn("range", F.lit(0)), weight, "h", {0: (1.0, ranges)}, 0)
    for i in range(1, most_rounds + 1):
        cuts = sorted(set(cuts))
        rows = _ranged(keys, cuts)
        held = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.sum(weight).alias("w"),
                                         F.max(weight).alias("top"), F.min("h").alias("low"), F.max("h").alias("high")).collect()  # a row for each range
        over = [r for r in held if r.rows > 1 and r.w - r.top > OVERFULL / ranges
                and (r.low < r.high or r.w > SPLIT_TEXT / shards)]
        if not over:
            break
        parts = lambda some: {r.range: (r.w, int(np.ceil(r.w * ranges))) for r in some}
        cuts += _sampled_cuts(rows, weight, "h", parts(r for r in over if r.low < r.high), i)
        cuts += _sampled_cuts(rows, weight, "tie", parts(r for r in over if r.low == r.high), i)
    else:
        raise RuntimeError("ranges did not come down to their share")
    at, slots, placed = 0, [0] * shards, []
    for r in sorted(held, key=lambda r: r.range):
        s = min(shards - 1, int((at + r.bytes / 2) * shards / total))
        placed.append((r.range, s, slots[s]))
        at, slots[s] = at + r.bytes, slots[s] + r.rows
    place = keys.sparkSession.createDataFrame(placed, "range int, shard int, before long")
    within = F.row_number().over(Window.partitionBy("range").orderBy("h", "tie"))
    return (rows.withColumn("n", within).join(F.broadcast(place), "range")  # as many rows as ranges
            .select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("before") + F.col("n") - 1).alias("slot")))
