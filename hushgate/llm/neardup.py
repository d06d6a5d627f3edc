"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots, in order of nearness. Inverted
lists hold the vectors for every three pivots among the nearest few: vectors
meet in a list exactly if they share three. A pair is verified, in double
precision, only in the list of the least three pivots it shares, so links are
counted once. Lists longer than a block are split, and pairs of blocks go to
different tasks; a task gives counts and the edges of a forest, never pairs.

Pivots are chosen from a bounded sample, the ``SAMPLE`` vectors with the
smallest hashes among those of the most frequent length; vectors of another
length have lists of their own, by random pivots that follow from the length.
Every vector is indexed. Equal vectors are one with a weight. The index is
approximate: recall is measured in the tests.

Defined results: vectors that are null, zero, or hold null or non-finite parts
link with nothing, and vectors of different lengths not with each other; null
and repeated keys are vectors of their own, their component is the least key in it; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import stage
from hushgate.llm.components import components

PIVOTS, NEAREST, SHARED = 256, 7, 3
SAMPLE = 2048
BLOCK = 2048
LEAST_COSINE = 0.9
#: Long lists are looked up from memory up to this number of them, and by a join beyond it.
MOST_LONG_LISTS = 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS, apart: float = 0.5, least: int = 4 * NEAREST) -> np.ndarray:
    """Vectors of the sample that lie apart, so that a dense group does not fill the list; others only up to ``least``."""
    free, kept = np.ones(len(sample), bool), []
    for i in range(len(sample)):
        if free[i] and len(kept) < most:
            kept.append(i)
            free &= sample @ sample[i] < apart
    rest = [i for i in range(len(sample)) if i not in set(kept)]
    return sample[kept + rest[: max(0, least - len(kept))]]


def random_pivots(length: int) -> np.ndarray:
    """Pivots for vectors of a length that was not sampled; fewer where few directions are to be told apart."""
    return _unit(np.random.default_rng(length).standard_normal((min(PIVOTS, 4 + 4 * length), length)))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the m nearest pivots of each row, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :m]


def lists_of(near: np.ndarray) -> np.ndarray:
    """List numbers of each row: one for every three of its pivots, least pivot first."""
    p = np.sort(near, axis=1)
    pick = np.array(list(combinations(range(p.shape[1]), min(SHARED, p.shape[1]))))
    out = np.zeros((len(p), len(pick)), np.int64)
    for k in range(pick.shape[1]):
        out = out * PIVOTS + p[:, pick[:, k]]
    return out


def _masks(near: np.ndarray) -> np.ndarray:
    out = np.zeros((len(near), PIVOTS // 64), np.uint64)
    for c in near.T:
        np.bitwise_or.at(out, (np.arange(len(out)), c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
    return out


def _below(pivot: int) -> np.ndarray:
    return np.array([(1 << max(0, min(64, pivot - 64 * w))) - 1 for w in range(PIVOTS // 64)], np.uint64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges ``(member, root)`` that connect what a symmetric matrix of links connects."""
    left, out = linked.any(axis=1), []
    for root in np.flatnonzero(left).tolist():
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            new = np.flatnonzero(linked[front].any(axis=0) & left)
            left[new] = False
            out += [(i, root) for i in new.tolist()]
            front = new.tolist()
    return out


#: Lists of one length; a list number is the length times this and three pivots.
LISTS = PIVOTS ** SHARED


def _verify(cosine: float):
    def group(key, rows):
        """Rows ``(list, i, j, node, weight, block, unit, near)`` of one pair of blocks."""
        length = key[0] // LISTS
        x, near = _unit(np.array([np.frombuffer(r[6], np.float32 if len(r[6]) == 4 * length else np.float64) for r in rows])), np.array([r[7] for r in rows])
        w, block = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        own = near_mask = _masks(near)
        shared = min(SHARED, near.shape[1])
        under = own & _below(key[0] % PIVOTS)  # pivots below the greatest of this list's
        linked = np.zeros((len(rows), len(rows)), bool)
        for a in range(0, len(rows), 512):
            hit = x[a: a + 512] @ x.T >= cosine
            common = np.zeros(hit.shape, np.uint8)
            for c in range(under.shape[1]):
                common += np.bitwise_count(under[a: a + 512, c][:, None] & near_mask[:, c][None, :])
            linked[a: a + 512] = hit & (common == shared - 1)
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:  # pairs within a block belong to another task
            linked &= block[:, None] != block[None, :]
        root = dict(_forest(linked))
        for k, n in enumerate((linked @ w).tolist()):
            if n:
                yield rows[k][3], n, rows[root[k]][3] if k in root else rows[k][3]

    def batch(out):
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for b in batches:
            flat = [b.column(c).to_pylist() for c in ("list", "i", "j", "node", "weight", "block", "vector", "near")]
            flat[7] = [np.frombuffer(v, np.int16).astype(np.int64) for v in flat[7]]
            for row in zip(*flat):
                if row[:3] != key:
                    if len(held) > 1:
                        out += group(key, held)
                    held, key = [], row[:3]
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
                held.append(row)
        if len(held) > 1:
            out += group(key, held)
        yield batch(out)
    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = LEAST_COSINE,
                    nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every vector."""
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    length = rows.filter("fine").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.select("key", "v", "fine", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("b"), "v").alias("h2"))
    classes = stage(rows.filter("fine").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("key").alias("least"), F.first("v").alias("v"))
                    .withColumn("node", F.monotonically_increasing_id()), "vectors")
    usual = F.size("v") == F.lit(length.d if length else 0)
    sample = [r.v for r in classes.filter(usual).orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).select("v").collect()]
    own = rows.select("key", "h1", "h2", "fine")
    if not sample:
        return own.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"),
                          F.col("key").isNotNull().alias("kept"))
    pivots_of = {length.d: choose_pivots(_unit(np.array(sample)))}

    def of_one_length(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(b.column("v"))
        for d in pc.unique(size):
            yield b.filter(pc.equal(size, d))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in of_one_length(whole)):
            raw = np.array(b.column("v").to_pylist(), np.float64)
            length = raw.shape[1]
            if length not in pivots_of:
                pivots_of[length] = random_pivots(length)
            pivots = pivots_of[length]
            short = raw.astype(np.float32)
            if (short == raw).all():  # as most tables have it; the task computes in double precision
                raw = short
            x = _unit(raw)
            near = nearest_pivots(x, pivots, min(nearest, len(pivots)))
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("weight"), pa.array([r.tobytes() for r in raw], pa.binary()),
                 pa.array([r.tobytes() for r in near.astype(np.int16)], pa.binary()), pa.array((lists_of(near) + length * LISTS).tolist(), pa.list_(pa.int64()))],
                names=["node", "weight", "vector", "near", "lists"])

    index = stage(classes.select("node", "weight", "v").mapInArrow(
        describe, "node long, weight long, vector binary, near binary, lists array<long>"), "pivot-index")
    sizes = index.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stage(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "list-sizes")
    long_lists = sizes.filter("blocks > 1")
    entries = index.select("node", "weight", "vector", "near", F.explode("lists").alias("list"))
    if long_lists.limit(MOST_LONG_LISTS + 1).count() <= MOST_LONG_LISTS:
        entries = entries.join(F.broadcast(long_lists.select("list", "blocks")), "list", "left")
    else:
        entries = entries.join(long_lists.select("list", "blocks"), "list", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = entries.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "weight", "block", "vector", "near")
    found = stage(tasks.repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(
        _verify(cosine), "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select("node", "root").distinct(), "node", "root")
    state = (classes.select("h1", "h2", "node", "weight", "least").join(links, "node", "left")
             .join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = state.groupBy("component").agg(F.min("least").alias("component_id"))
    state = state.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id",
                                                  F.lit(True).alias("fine"))
    out = own.join(state, ["h1", "h2", "fine"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
