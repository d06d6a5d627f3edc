"""Exact Jaccard join of word n-grams and its components, by skipping over set relations.

Index: sets put their tokens in one order, common ones last; two sets as
similar as asked share one of their first tokens. The index has a list for
each such token, split into blocks by set size so that only equal and
neighbouring blocks meet, and a position bound drops entries too far down
their set.

Answers: equal sets are one set. Every set is first compared with one leader
of its lists, the most promising one. The leader of a list is the set that
holds least before the list's token: a copy's own edits are rare tokens and
come first, so among near copies it is the text they stem from or one close
to it, which answers for far more of them than any copy would. Sets that reach one another over their
answers share these, and a list whose sets share theirs is skipped. Pairs are
formed only between different components of a list. Parities of hashed tokens
bound the difference of two sets from below, and what passes is compared
exactly.

Which tokens count as common is found by counting all tokens of all documents
locally; the order changes the work, never the result. The table of common
tokens has a fixed size.

Defined results: null and blank texts have empty sets and link with nothing;
a document without key gets no component; rows that repeat a key are one node;
empty tables give no rows; other columns are ignored. Shingles are compared
by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import mix64, only_buckets_of, small_batches, stage, stage_alone, text_buffer, tidy
from hushgate.llm.components import components

#: Common tokens: kept entries, least sum of local counts, tokens counted at a time, share of documents that counts locally.
COMMON, LEAST_COMMON, COUNTED, LOCAL_SHARE = 1 << 18, 24, 1 << 22, 4000
#: Least bits of a parity map; a larger set has as many as it has tokens, up to a power of two.
PARITY_BITS = 512
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BASE = 0xA0761D6478BD642F
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_powers: list[np.ndarray] = []


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A hash of each word of a text, in order; long texts are cut at blanks."""
    parts, first = [], 0
    while first < len(buf):
        end = len(buf)
        if end - first > most:
            blank = np.flatnonzero(_SPACE[buf[first + most:]][: 1 << 22])
            end = first + most + int(blank[0]) if len(blank) else len(buf)
        b = _LOWER[buf[first:end]]
        solid = np.r_[False, ~_SPACE[b], False]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, stop = edge[::2], edge[1::2]
        up, down = _up_down(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_CODES[b] * up[: len(b)], out=total[1:])
        parts.append(mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        first = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(buf: np.ndarray, n: int = 3) -> np.ndarray:
    """Sorted different hashes of every n words, or of the whole text where it has fewer."""
    w = word_hashes(buf)
    if not len(w):
        return w
    width = min(n, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in reversed(range(width)):
        h = mix64(w[k: k + len(h)] + h)
    return np.unique(h)


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    buf, at = text_buffer(column)
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        yield shingle_set(buf[a:z], n)


def common_tokens(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """At most ``COMMON`` tokens, rarest first, among those frequent in some stretch of the documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(sets):
            tokens, times = np.unique(np.concatenate(sets), return_counts=True)
            keep = times >= max(2, len(sets) // LOCAL_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(times[keep])], names=["token", "n"])

        held, size = [], 0
        for b in batches:
            for s in _sets(b.column(0), n):
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    yield frequent(held)
                    held, size = [], 0
        if held:
            yield frequent(held)

    with small_batches(docs.sparkSession):
        top = (docs.select(text).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
               .filter(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "token").limit(COMMON).toPandas())
    return top["token"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def set_index(docs: DataFrame, common: np.ndarray, key: str, text: str, n: int, percent: int) -> DataFrame:
    """``(key, n, d1, d2, first, parity)``: size and digest of each set, its first tokens and parities of all."""
    by_hash = np.argsort(common)
    known, rank = common[by_hash], by_hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, firsts, parities = [], [], [], []
            for s in _sets(b.column(1), n):
                at = np.searchsorted(known, s)
                hot = np.zeros(len(s), bool)
                if len(known):
                    hot = known[np.minimum(at, len(known) - 1)] == s
                order = np.r_[s[~hot], s[hot][np.argsort(rank[at[hot]])]] if hot.any() else s
                firsts.append(order[: len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0].view(np.int64))
                bits = max(PARITY_BITS, 1 << max(0, len(s) - 1).bit_length())
                place = (mix64(s + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)
                parities.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes())
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            as_list = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(d[:, j])) for j in (0, 1)),
                 as_list(firsts), pa.array(parities, pa.binary())], names=["key", "n", "d1", "d2", "first", "parity"])

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(
        tidy(run), "key long, n long, d1 long, d2 long, first array<long>, parity binary")


def _compare(percent: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(_sets(b.column(2), n), _sets(b.column(3), n)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])
    return run


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Of pairs ``(a, b)`` those whose sets are as similar as asked. Only their texts are shuffled."""
    return stage_alone(docs.sparkSession, "links", lambda: _compared(pairs, docs, key, text, n, percent)).distinct()


def _compared(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    needed = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    texts = only_buckets_of(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), needed, "k")
    texts = stage(texts.join(needed, "k", "left_semi").distinct(), "pair-texts")
    both = (pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
            .join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb"))
    return both.mapInArrow(_compare(percent, n), "a long, b long")


def least_difference(x: bytes, y: bytes) -> int:
    """Odd places of one parity map against the other; the larger map is folded to the size of the smaller."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([least_difference(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())], np.int64)
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = pa.array(least * (100 + percent) <= both * (100 - percent))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column("a"), batch.column("b"), pa.array(least))], names=["a", "b", "least"])
    return run


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Add ``least``, a lower bound of the sets' difference, and drop pairs it rules out."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    sized = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(sized)
    return rows.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_bounded(percent), "a long, b long, least long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every document: links are pairs of Jaccard ``percent`` or more.

    The result is staged; sets, lists and texts of pairs go once it is written.
    """
    return stage_alone(docs.sparkSession, "set-components", lambda: _components_of_sets(docs, key, text, n, percent))


def _components_of_sets(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    found = stage(set_index(docs, common_tokens(docs, text, n), key, text, n, percent), "sets")
    sets = stage(found.filter("n > 0 and key is not null").groupBy("d1", "d2").agg(
        F.min("key").alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("parity").alias("parity")), "set-reps")
    entries = sets.select("rep", F.posexplode("first").alias("pos", "token"))
    # Sums are staged where rows come back to them, so that Spark can split the rows of a hot token.
    lists = stage(entries.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token"), "list-tokens")
    index = stage(entries.join(lists, "token"), "lists")
    # Each set and the most promising leader of its lists.
    leaders = stage(index.groupBy("token").agg(F.min(F.struct("pos", "rep")).alias("m")).select("token", F.col("m.rep").alias("a")), "leaders")
    led = index.join(leaders, "token").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    best = _near(led, sets, percent).groupBy("b").agg(F.min(F.struct("least", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    links = _verified(best.select("a", "b"), docs, key, text, n, percent)
    known = stage_alone(docs.sparkSession, "answers", lambda: components(links))
    # Lists that hold more than one component, in blocks by size: a set meets its own block and the next.
    block = F.floor(F.log("n") / np.log(100 / percent)).cast("int")
    rows = (index.join(known, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep"))
            .select("token", "pos", "rep", "c").join(sets.select("rep", "n", block.alias("block")), "rep"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("token")
    rows = stage(rows.join(stage(mixed, "mixed"), "token"), "open-lists")
    left = rows.select("token", F.col("pos").alias("ip"), F.col("rep").alias("i"), F.col("c").alias("ic"), F.col("n").alias("in"),
                       F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("block").alias("ib"))
    right = rows.select("token", "block", F.col("pos").alias("jp"), F.col("rep").alias("j"), F.col("c").alias("jc"), F.col("n").alias("jn"))
    left_over = F.least(F.col("in") - F.col("ip"), F.col("jn") - F.col("jp"))
    met = left.join(right, ["token", "block"]).filter(
        (F.col("ic") != F.col("jc")) & ((F.col("ib") < F.col("block")) | (F.col("i") < F.col("j")))
        & (F.least("in", "jn") * 100 >= F.greatest("in", "jn") * percent)
        & (left_over * (100 + percent) >= (F.col("in") + F.col("jn")) * percent))
    pairs = met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    more = _verified(stage(_near(pairs, sets, percent).select("a", "b"), "pairs"), docs, key, text, n, percent)
    final = components(links.unionByName(more))
    mine = sets.select("d1", "d2", "rep").join(final, F.col("rep") == F.col("node"), "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"))
    return found.select("key", "n", "d1", "d2").join(mine, ["d1", "d2"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))).alias("component_id"))
