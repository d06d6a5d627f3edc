"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline.

Texts are encoded by a byte-level vocabulary (A) and by a sentence-piece model
(B). A chunk of documents is then a few Arrow arrays: list columns of ids are
flattened, parent indices name the document of each token, and cumulative sums
of token lengths within documents give byte ends. An Acero join on
(document, end) finds the offsets where tokens of both end; the running count
of these numbers the groups. Tokens of one group are linked, each with each.

How many documents hold an id pair linked is counted by ``Table.group_by`` in
each task, and Spark merges the partial counts. Documents then look their
pairs up: those among the ``FREQUENT`` most frequent ones in a table of that
fixed size that every task holds, all others by a join on the pair, so that
only rare pairs are shuffled and none of them is hot.

Encoded rows are staged once, with a row number of their own, and carry their
pairs as two lists sorted by pair.

Defined results: null and empty texts, and texts whose tokens of A or of B do
not spell a blank and the text byte for byte, have no tokens and all zeros;
null keys and repeated rows are documents of their own; an empty table gives
no rows; other columns are ignored. One text is encoded at a time, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import stage
from hushgate.llm.packing import PIECES_OF_TEXT, byte_ranks

#: Bytes of text that are aligned at a time; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Pairs that every task looks up by itself, and partial counts that a task holds before it hands them on.
FREQUENT, HELD = 1 << 16, 1 << 20
#: Groups with more links are counted by distinct ids first.
LARGE_GROUP = 1 << 12


class Encoders:
    """Both tokenizers, the byte length of each of their tokens, and their bytes."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(byte_bpe)
        self.whole.encode_special_tokens = True
        ranks = byte_ranks(self.whole.get_vocab())
        self.a = tiktoken.Encoding("a", pat_str=PIECES_OF_TEXT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelt_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            spelt_a[i] = token
        spelt_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.spelt_a, self.spelt_b = (pa.array(s, pa.large_binary()) for s in (spelt_a, spelt_b))
        self.length_a, self.length_b = (pc.binary_length(s) for s in (self.spelt_a, self.spelt_b))
        self.many_b = len(spelt_b)
        # An id and what follows it in the written form of the groups.
        written = lambda n, ends: pa.array([f"{i}{e}" for i in range(n) for e in ends], pa.large_string())
        self.written = pa.concat_arrays([written(len(spelt_a), (",", "|")), written(len(spelt_b), (",", ";", ""))])
        self.written_b = 2 * len(spelt_a)

    def tokens(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """Ids by A and by B of each text; empty lists where either does not spell the blank and the text."""
        a, b = [], []
        for text in texts:
            x = self._bytewise(f" {text}") if text else np.zeros(0, np.uint32)
            y = np.zeros(0, np.uint32) if not text else np.array(self.b.encode(text), np.uint32)
            if text and not self._spell(text, x, y):
                x = y = x[:0]
            a.append(x.astype(np.int32))
            b.append(y.astype(np.int32))
        return tuple(pa.LargeListArray.from_arrays(np.r_[0, np.cumsum([len(v) for v in side])].astype(np.int64),
                                                   np.concatenate([*side, np.zeros(0, np.int32)])) for side in (a, b))

    def _bytewise(self, text: str) -> np.ndarray:
        try:
            return self.a.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of blanks beyond its pattern's stack; the slower library has the same vocabulary
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _spell(self, text: str, x: np.ndarray, y: np.ndarray) -> bool:
        want = f" {text}".encode()
        if int(pc.sum(self.length_b.take(pa.array(y))).as_py() or 0) != len(want):
            return False
        return _joined(self.spelt_a, x) == want and _joined(self.spelt_b, y) == want


def _joined(spelt: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of tokens one after the other: those of the taken array."""
    taken = spelt.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[[taken.offset, taken.offset + len(taken)]]
    return taken.buffers()[2][at[0]: at[1]].to_pybytes()


def _ends(tokens: pa.LargeListArray, length: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids, documents and byte ends of all tokens: lists flattened, sums of lengths that start anew in each document."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(length.take(ids).cast(pa.int64())).to_numpy(zero_copy_only=False)
    before = np.r_[0, total][tokens.offsets.to_numpy()[:-1]]
    return ids, doc, total - before[doc.to_numpy()]


def align(a: pa.LargeListArray, b: pa.LargeListArray, enc: Encoders) -> list[pa.Array]:
    """Of each document: n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs in order, and how many links each has."""
    n = len(a)
    ids_a, doc_a, end_a = _ends(a, enc.length_a)
    ids_b, doc_b, end_b = _ends(b, enc.length_b)
    side = lambda doc, end, at: pa.table({"doc": doc.cast(pa.int64()), "end": end, at: np.arange(len(end))})
    both = side(doc_a, end_a, "i").join(side(doc_b, end_b, "j"), ["doc", "end"], join_type="inner", use_threads=False)
    last_a, last_b = np.sort(both["i"].to_numpy()), np.sort(both["j"].to_numpy())  # the last tokens of each group
    groups = len(last_a)
    first_a, first_b = np.r_[0, last_a + 1][:groups], np.r_[0, last_b + 1][:groups]
    many_a, many_b = last_a - first_a + 1, last_b - first_b + 1
    doc = doc_a.to_numpy()[last_a]
    per_doc = lambda w=None: np.bincount(doc, w, n).astype(np.int64)
    n_a, n_b = (np.diff(x.offsets.to_numpy()) for x in (a, b))

    ids_a, ids_b = ids_a.to_numpy(), ids_b.to_numpy()
    group_a, group_b = np.repeat(np.arange(groups), many_a), np.repeat(np.arange(groups), many_b)
    pairs = _pairs(ids_a, ids_b, group_a, first_b, many_b, many_a * many_b <= LARGE_GROUP, doc, enc.many_b)
    if large := np.flatnonzero(many_a * many_b > LARGE_GROUP).tolist():
        for g in large:
            x, nx = np.unique(ids_a[first_a[g]: last_a[g] + 1], return_counts=True)
            y, ny = np.unique(ids_b[first_b[g]: last_b[g] + 1], return_counts=True)
            pairs = pa.concat_tables([pairs, pa.table({
                "doc": np.full(len(x) * len(y), doc[g]), "pair": (x[:, None].astype(np.int64) * enc.many_b + y).ravel(),
                "links": (nx[:, None] * ny).ravel().astype(np.int64)})])
    pairs = pairs.group_by(["doc", "pair"], use_threads=False).aggregate([("links", "sum")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
    pairs = pairs.combine_chunks()
    at = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32))
    flat = lambda c: pairs[c].combine_chunks() if pairs.num_rows else pa.array([], pa.int64())
    lists = [pa.ListArray.from_arrays(at, flat(c)) for c in ("pair", "links_sum")]

    # Written form: tokens of A and of B take turns by group, so a token's place is its own index and the other side's before.
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    place_a = np.arange(len(ids_a)) + first_b[group_a]
    place_b = np.arange(len(ids_b)) + (last_a + 1)[group_b]
    ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ends_a[last_a], ends_b[last_b] = 1, 1
    ends_b[(b.offsets.to_numpy()[1:] - 1)[n_b > 0]] = 2
    out[place_a] = ids_a.astype(np.int64) * 2 + ends_a
    out[place_b] = enc.written_b + ids_b.astype(np.int64) * 3 + ends_b
    text = enc.written.take(pa.array(out))
    start = np.frombuffer(text.buffers()[1], np.int64)
    doc_at = np.r_[0, np.cumsum(n_a + n_b)]
    data = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
    shas = [hashlib.sha256(data[start[x]: start[y]]).hexdigest() if y > x else "" for x, y in zip(doc_at, doc_at[1:])]
    return [pa.array(n_a), pa.array(n_b), pa.array(per_doc()), pa.array(per_doc(many_a * many_b)), pa.array(shas), *lists]


def _pairs(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, first_b: np.ndarray, many_b: np.ndarray, small: np.ndarray,
           doc: np.ndarray, many: int) -> pa.Table:
    """One row for each link of the groups told: every token of A with each token of B of its group."""
    i = np.flatnonzero(small[group_a])
    g = group_a[i]
    times = many_b[g]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    j = np.repeat(first_b[g], times) + step
    pair = np.repeat(ids_a[i].astype(np.int64), times) * many + ids_b[j]
    return pa.table({"doc": np.repeat(doc[g], times), "pair": pair, "links": np.ones(len(pair), np.int64)})


def _chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, byte_bpe: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's counts, digest and linked pairs, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["_row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        enc = Encoders(byte_bpe, pieces)
        for batch in batches:
            texts = batch.column(2)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for x, y in _chunks(sizes):
                a, b = enc.tokens([t or "" for t in texts[x:y].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], batch.column(1)[x:y], *align(a, b, enc)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(text))
    return rows.mapInArrow(run, f"_row long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "pairs array<long>, links array<long>")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """In how many documents each pair is linked; partial counts of tasks, merged by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return (pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
                    .rename_columns(["pair", "n"]).combine_chunks())

        for b in batches:
            pair = pc.list_flatten(b.column(0))
            held.append(pa.table({"pair": pair, "n": pa.repeat(pa.scalar(1, pa.int64()), len(pair))}))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:  # too many different ones to go on
                    yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return encoded.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, byte_bpe: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: token, group and link counts, links at their best count, sum of counts, digest of the groups."""
    encoded = stage(encode(docs, byte_bpe, pieces, key, text), "aligned")
    many_b = _piece_count(pieces)
    counts = pair_counts(encoded).withColumn("_a", F.floor(F.col("pair") / many_b))
    counts = stage(counts, "pair-counts")
    # Broadcast: one row for each id of A at most.
    best = counts.groupBy("_a").agg(F.max("n").alias("_most"))
    known = stage(counts.join(F.broadcast(best), "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "pair-counts")
    top = known.orderBy(F.desc("n"), "pair").limit(FREQUENT).toArrow().sort_by("pair")
    frequent, n, is_best = (top[c].to_numpy() for c in ("pair", "n", "best"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = len(b)
            doc = pc.list_parent_indices(b.column(1)).to_numpy()
            pair, links = (pc.list_flatten(b.column(c)).to_numpy() for c in (1, 2))
            at = np.searchsorted(frequent, pair)
            if len(frequent):
                at = np.minimum(at, len(frequent) - 1)
                has = frequent[at] == pair
            else:
                has = np.zeros(len(pair), bool)
            d, x, m = doc[has], at[has], links[has]
            count_sum, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(count_sum, d, m * n[x])
            np.add.at(n_best, d, m * is_best[x])
            offsets = pa.array(np.searchsorted(doc[~has], np.arange(size + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~has])) for v in (pair, links)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best), pa.array(count_sum), *rest],
                                             names=["_row", "n_best", "count_sum", "pairs", "links"])

    found = stage(encoded.select("_row", "pairs", "links").mapInArrow(
        look_up, "_row long, n_best long, count_sum long, pairs array<long>, links array<long>"), "looked-up")
    rest = (found.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
            .select("_row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
            .join(known, "pair").groupBy("_row")
            .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum")))
    return (encoded.drop("pairs", "links").join(found.drop("pairs", "links"), "_row").join(rest, "_row", "left")
            .select(key, "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256"))


def _piece_count(pieces: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
