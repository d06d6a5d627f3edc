"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every string of ``LENGTH`` bytes is a suffix cut at the threshold. Its first
digit is its least hashed gram, so neighbouring suffixes with the same gram
(an anchor) stay one row: a range of offsets before the anchor. Passes:

1. anchors whose gram occurs once are dropped;
2. anchors whose whole range, as one string, occurs again are settled;
3. the others are sorted within their gram by halving the range of offsets:
   suffixes whose common bytes differ part, those whose ranges are equal are
   settled, down to single suffixes.

Equal groups at full depth are the repeated strings. Grams and ranges are
compared by hash (128 bits for ranges), pass 3 compares bytes. Counts are
aggregates that combine before the shuffle, rows come back by joins that can
be split; a gram with very many different ranges is not gathered but counted
suffix by suffix. Equal texts are one text from pass 3 on.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all
bytes; null keys and repeated rows are documents of their own, so a repeated
row of enough bytes loses all of them; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import empty_text, mix64, only_buckets_of, stage, text_buffer

LENGTH = 400
GRAM = 64
#: Grams with more different ranges than this are counted suffix by suffix.
MOST_IN_GROUP = 8192
#: Bytes hashed at a time; neighbouring stretches overlap by a string's length.
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = (_powers(b, STRETCH + LENGTH + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def gram_hashes(buf: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A hash of every k bytes of ``buf``."""
    n = len(buf)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[buf] * _UP[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * _DOWN[: n - k + 1])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least of each w consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1: w - 1 + n])
    # A window's place is the next one, from its start, that holds its least value.
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    places = np.flatnonzero(np.isin(h, least[starts]))
    places = places[np.argsort(h[places], kind="stable")]  # ascending for equal values
    ranked, values = h[places], least[starts]
    low, high = np.searchsorted(ranked, values, "left"), np.searchsorted(ranked, values, "right")
    ends = np.r_[starts[1:], n]
    out = np.repeat(places[low], ends - starts)
    for k in np.flatnonzero(high - low > 1).tolist():
        at = places[low[k]:high[k]]
        out[starts[k]:ends[k]] = at[np.searchsorted(at, np.arange(starts[k], ends[k]))]
    return out


def anchors(b: bytes, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(place, gram hash, lo, hi)``: strings that begin ``lo`` to ``hi`` bytes before a place have their least gram there.

    Long texts are hashed stretch by stretch; a place may then have two ranges.
    """
    parts = []
    for first in range(0, max(1, len(b) - length + 1), STRETCH):
        h = gram_hashes(np.frombuffer(b, np.uint8, min(len(b) - first, STRETCH + length - 1), first), k)
        at = window_minima(h, length - k + 1)
        if len(at):
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            end = np.r_[start[1:], len(at)] - 1
            parts.append((at[start] + first, h[at[start]], at[start] - end, at[start] - start))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in (int, np.uint64, int, int))


ROW = "h1 long, h2 long, pos int, lo int, hi int, gram long, c1 long, c2 long"
SPAN = "h1 long, h2 long, start int, end int"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, at = text_buffer(batch.column(2))
        data, h1, h2 = buf.tobytes(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows, digests = [], []
        for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            b = data[a:z]
            pos, gram, lo, hi = anchors(b)
            rows.append((np.full(len(pos), i), pos, lo, hi, gram))
            digests += [xxhash.xxh3_128_digest(b[p - y: p - x + LENGTH], seed=y)
                        for p, x, y in zip(pos.tolist(), lo.tolist(), hi.tolist())]
        if digests:
            i, pos, lo, hi, gram = (np.concatenate(c) for c in zip(*rows))
            c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[i]), pa.array(h2[i]), *(pa.array(x.astype(np.int32)) for x in (pos, lo, hi)),
                 pa.array(gram.view(np.int64)), *(pa.array(np.ascontiguousarray(c[:, j])) for j in (0, 1))],
                names=["h1", "h2", "pos", "lo", "hi", "gram", "c1", "c2"])


def repeated_in_group(members: list[tuple[bytes, int, int, int]]) -> list[list[tuple[int, int]]]:
    """For each ``(bytes, place of the anchor, lo, hi)`` the ranges of offsets whose string another member has too.

    Members are different places of texts. A pass parts the members by the
    bytes that all strings of an offset range share, settles equal ranges and
    halves the rest.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in members]
    work = [(list(range(len(members))), 0, LENGTH - GRAM, frozenset())]
    while work:
        group, m1, m2, done = work.pop()
        parted = defaultdict(list)
        for i in group:
            b, a, lo, hi = members[i]
            if max(lo, m1) <= min(hi, m2):  # then the shared bytes lie within the text
                parted[b[a - m1: a - m2 + LENGTH]].append(i)
        for bucket in parted.values():
            if len(bucket) < 2 or all(i in done for i in bucket):
                continue
            equal = defaultdict(list)
            for i in bucket:
                b, a, lo, hi = members[i]
                x, y = max(lo, m1), min(hi, m2)
                equal[x, y, b[a - y: a - x + LENGTH]].append(i)
            rest, settled = [], set(done.intersection(bucket))
            for (x, y, _), same in equal.items():
                if len(same) > 1:
                    for i in same:
                        if i not in settled:
                            found[i].append((x, y))
                    settled.update(same)
                rest.append(same[0])
            if m1 < m2 and len(rest) > 1 and any(i not in settled for i in rest):
                mid, now = (m1 + m2) // 2, frozenset(settled)
                work += [(rest, m1, mid, now), (rest, mid + 1, m2, now)]
    return found


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the ranges of open anchors, cut from their texts."""
    names = ["gram", "h1", "h2", "pos", "lo", "hi", "bytes"]
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
    for batch in batches:
        for h1, h2, text, places in zip(*batch.columns):
            b, h1, h2 = text.as_py().encode("utf-8"), h1.as_py(), h2.as_py()
            rows = [(p["gram"], h1, h2, p["pos"], p["lo"], p["hi"], b[p["pos"] - p["hi"]: p["pos"] - p["lo"] + LENGTH])
                    for p in places.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _spans_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 2)],
                                      names=["h1", "h2", "start", "end"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram: sort each gram's suffixes and give the repeated strings as spans."""
    def spans(rows):
        # ``bytes`` begins at the first suffix, so the anchor stands ``hi`` bytes into it.
        for row, ranges in zip(rows, repeated_in_group([(r[6], r[5], r[4], r[5]) for r in rows])):
            for x, y in ranges:
                yield row[1], row[2], row[3] - y, row[3] - x + LENGTH

    held, gram, out = [], None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != gram:
                out += spans(held)
                held, gram = [], row[0]
                if len(out) > 20_000:
                    yield _spans_batch(out)
                    out = []
            held.append(row)
    yield _spans_batch(out + list(spans(held)))


def _single_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*batch.columns):
            _, h1, h2, pos, lo, hi, b = (x.as_py() for x in row)
            n = hi - lo + 1
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b[i: i + LENGTH]) for i in range(n)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(keys[:, j])) for j in (0, 1)), pa.array(np.full(n, h1)), pa.array(np.full(n, h2)),
                 pa.array(np.arange(pos - hi, pos - lo + 1, dtype=np.int32))], names=["k1", "k2", "h1", "h2", "start"])


def _one_of_each(texts: DataFrame) -> DataFrame:
    return texts.filter(F.octet_length("text") >= LENGTH).groupBy("h1", "h2").agg(F.first("text").alias("text"))


def repeated_spans(texts: DataFrame, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """``(h1, h2, start, end)`` of repeated strings, from ``(h1, h2, text)`` with all copies; spans can overlap."""
    found = stage(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(_find_anchors, ROW), "anchors")
    # Counts are staged before rows come back to them, so that Spark can split the rows of a hot gram.
    again = stage(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams-again")
    first = stage(found.join(again, "gram"), "anchors-again")
    ranges = stage(first.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("h1").alias("of")), "ranges")
    first = stage(first.join(ranges, ["c1", "c2"]).select(
        "h1", "h2", "pos", "lo", "hi", "gram", (F.col("n") > 1).alias("settled"), (F.col("h1") == F.col("of")).alias("shown")), "anchors-settled")
    spans = first.filter("settled").select("h1", "h2", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + LENGTH).alias("end"))
    # What is open meets one place of each settled range of its gram.
    mixed = first.groupBy("gram").agg(F.sum(F.when(F.col("settled"), 0).otherwise(1)).alias("open"),
                                      F.sum(F.when(F.col("shown"), 1).otherwise(0)).alias("n")).filter("open > 0")
    mixed = stage(mixed, "mixed")
    rows = first.filter("shown or not settled").join(mixed.select("gram", (F.col("n") > most_in_group).alias("many")), "gram")
    places = stage(rows.groupBy("h1", "h2").agg(F.collect_set(F.struct("gram", "pos", "lo", "hi", "many")).alias("places")), "open-places")
    open_texts = stage(_one_of_each(only_buckets_of(texts, places, "h1")).join(places, ["h1", "h2"]).select("h1", "h2", "text", "places"), "open-texts")

    def contexts(many: bool) -> DataFrame:
        some = open_texts.withColumn("places", F.filter("places", lambda p: p["many"] == many)).filter("size(places) > 0")
        return some.mapInArrow(_contexts, "gram long, h1 long, h2 long, pos int, lo int, hi int, bytes binary")

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = spans.unionByName(contexts(False).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_sort_groups, SPAN))
    if not mixed.filter(F.col("n") > most_in_group).isEmpty():
        single = stage(contexts(True).mapInArrow(_single_suffixes, "k1 long, k2 long, h1 long, h2 long, start int"), "suffixes")
        twice = single.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
        spans = spans.unionByName(single.join(twice, ["k1", "k2"]).select("h1", "h2", "start", (F.col("start") + LENGTH).alias("end")))
    return spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


DONE = "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    for batch in batches:
        out = []
        for row in zip(*batch.columns):
            h1, h2, text, spans = (x.as_py() for x in row)
            b, kept, at = text.encode("utf-8"), [], 0
            runs = merge([(s["start"], s["end"]) for s in spans])
            for start, end in runs:
                kept.append(b[at:start])
                at = end
            rest = b"".join([*kept, b[at:]])
            out.append((h1, h2, len(b) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                         names=[x.split()[0] for x in DONE.split(", ")])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, kept)``; ``kept`` is the remaining bytes, null where nothing was removed."""
    t = empty_text(F.col(text).cast("string"))
    rows = docs.select(F.col(key), t.alias("text"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("b"), t).alias("h2"))
    texts = rows.select("h1", "h2", "text")
    runs = repeated_spans(texts, most_in_group).groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    runs = stage(runs, "runs")
    done = _one_of_each(only_buckets_of(texts, runs, "h1")).join(runs, ["h1", "h2"]).select("h1", "h2", "text", "spans").mapInArrow(_remove, DONE)
    whole = rows.select(key, "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    zero = F.lit(0).cast("long")
    return whole.join(done, ["h1", "h2"], "left").select(
        key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"), "kept")
