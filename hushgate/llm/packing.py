"""Hierarchical packing of tokenized documents into sequences of several lengths.

A document gives whole windows of the longest length and a remainder, which
goes to the tier of the next power of two. Remainders of the longest tier open
windows; the gaps in these are filled from the shorter tiers, shortest first.
Gaps and fillers lie end to end on two lines, by prefix sums of tokens, so a
piece is where a filler meets a gap. What the fillers do not reach, or the
gaps do not take, is cut into sequences of its tier's length.

Lines are ordered by a hash bucket and row number. The driver sees sums per
bucket and tier, whose number is fixed; documents meet their places by joins.

Defined results: a null text is an empty one, which still has the end id; null
and repeated keys are documents of their own; an empty table gives no pieces;
other columns are ignored. At most one sequence of each tier is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushgate.llm.common import kept_by, stage, tidy


LONGEST, SHORTEST = 1024, 128
END_ID = 0
#: Hash buckets of the lines: the number of sums the driver sees for each tier.
BUCKETS = 4096
#: Gaps and fillers are matched in cells of so many tokens.
CELL = 4096
#: Tokens of one training step, the same for every tier.
STEP_TOKENS = 65536
#: Characters that are encoded at a time.
CHUNK_CHARS = 2_000_000
PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, " \
         "tier int, step_group long"

# Blanks inside a run of other white space belong to it; elsewhere a blank always begins a token, and so does a line end
# that stands alone. Marks after a word are tokens apart from it.
_RUN, _LINES = re.compile(r"\s \s"), re.compile(r"\s\n|\n\s")
#: White space but for blank and line end, by any of the libraries' rules.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
#: What every match of these two holds: two of blank and line end side by side, or other white space.
_NOT_PLAIN = ["  ", " \n", "\n ", "\n\n", *_OTHER_SPACE]
#: Words without letters or signs, or with white space other than a line end at the start.
_ODD = rf"^\n?$|[{_OTHER_SPACE}]|(?s:.)\n"
#: Fixed value: how byte-level BPE of this kind cuts text before merging.
PIECES_OF_TEXT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary by bytes: printable Latin-1 stands for itself, the other bytes for characters from 256 on."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    other = [c for c in range(256) if c not in set(plain)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(other)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)
            and not token.startswith("<|")}


class Encoder:
    """Token ids of texts, by their distinct words: a token never spans the blank before a word.

    Words are merged by the faster of two libraries with the same vocabulary, whole texts by the other. Nothing is
    kept from call to call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bpe = tiktoken.Encoding("same", pat_str=PIECES_OF_TEXT, mergeable_ranks=byte_ranks(self.tokenizer.get_vocab()), special_tokens={})
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with ``before`` ahead of each, and where line ends are among them: each is a token of its own."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(before, words.type))[0].as_py()
        ids = self.bpe.encode_to_numpy(before + text, disallowed_special=()).astype("<u4", copy=False)
        return ids, np.flatnonzero(ids == self.line_end)

    def _words(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of words as they stand after a blank, or after the line end they begin with; where those of each begin
        in all the ids, and their number."""
        lines = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False)
        ids, first, count, size = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for some, blank in ((~lines & ~odd, 1), (lines & ~odd, 0)):
            if some.any():
                # A word has the ids up to the next line end, and the line end it begins with.
                got, cut = self._joined(words.filter(pa.array(some)), "\n ") if blank else self._joined(
                    pc.utf8_slice_codeunits(words.filter(pa.array(some)), 1), "\n")
                first[some], count[some] = size + cut + blank, np.diff(np.append(cut, len(got))) - blank
                ids.append(got)
                size += len(got)
        for i in np.flatnonzero(odd).tolist():
            word = words[i].as_py()
            got = self._ids([word if lines[i] else f" {word}"])[0]
            first[i], count[i] = size, len(got)
            ids.append(got)
            size += len(got)
        return ids, first, count

    def _spaced(self, text: str) -> str | None:
        """The text with a blank ahead of each line end a word begins with; None if it can't be cut at blanks."""
        if any(t in text for t in self.added):
            return None
        plain = not any(x in text for x in _NOT_PLAIN)
        if not plain and _RUN.search(text):
            return None
        if plain or not _LINES.search(text):
            return text.replace("\n", " \n")
        return None if text[:1] == "\n" or " \n" in text else text

    def _parts(self, text: str) -> list[str] | None:
        spaced = self._spaced(text)
        return None if spaced is None else spaced.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        cut = [self._spaced(t) for t in texts]
        # The first word of a text has no blank before it, so it stands with the texts that are not cut.
        heads = self._ids([t if c is None else c.partition(" ")[0] for t, c in zip(texts, cut)])
        parts = pc.split_pattern(pa.array([c or "" for c in cut], pa.large_string()), " ")
        each, text_at = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
        del cut, parts
        ids, first, count = self._words(each.dictionary)
        which = each.indices.to_numpy()
        first, count = first[which], count[which]
        count[text_at[:-1]] = [len(h) for h in heads]
        first[text_at[:-1]] = sum(map(len, ids)) + np.cumsum([0, *map(len, heads[:-1])])
        end = np.cumsum(count)
        out = np.concatenate([*ids, *heads])[np.repeat(first - end + count, count) + np.arange(end[-1])]
        return np.split(out, end[text_at[1:-1] - 1])


def encoder(path: str) -> Encoder:
    kept = kept_by(__name__)
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc_id, tokens, ids)``: ids of the whole text and the end id, as 16-bit numbers where they fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            sizes = np.cumsum([len(t) for t in b.column("t").fill_null("").to_pylist()])
            first = 0
            while first < len(b):
                end = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + CHUNK_CHARS, "right")))
                part = b.slice(first, end - first)
                ids = [np.append(x, np.uint32(END_ID)) for x in enc.encode(part.column("t").fill_null("").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("k"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([(x.astype("<u2") if x.max() < 65536 else x.astype("<u4")).tobytes() for x in ids], pa.binary())],
                    names=["row", "doc_id", "tokens", "ids"])
                first = end

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(tidy(run), f"row long, doc_id {kind}, tokens long, ids binary")


def _on_lines(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """Add to each remainder its tier, its place ``at`` on the line of its tier and its ``number`` there,
    and the number of the document's first whole window. The sums are by tier: tokens, remainders, whole windows."""
    rest = F.col("tokens") % LONGEST
    tier = F.when(rest == 0, 0).otherwise(F.greatest(F.lit(SHORTEST), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(rest, F.lit(1))))))).cast("int")
    rows = rows.select("row", "tokens", tier.alias("tier"), rest.alias("rest"), (F.col("tokens") - rest).alias("whole"),
                       F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    sums = rows.groupBy("tier", "bucket").agg(F.sum("rest").alias("t"), F.count("*").alias("n"),
                                              (F.sum("whole") / LONGEST).cast("long").alias("w")).collect()  # fixed number
    before, total, whole = [], {}, 0
    for r in sorted(sums, key=lambda r: (r.tier, r.bucket)):
        t, n, w = total.get(r.tier, (0, 0, 0))
        before.append((r.tier, r.bucket, t, n, whole))
        total[r.tier], whole = (t + r.t, n + r.n, w + r.w), whole + r.w
    place = rows.sparkSession.createDataFrame(before, "tier int, bucket int, t0 long, n0 long, w0 long")
    so_far = Window.partitionBy("tier", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    sum0 = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    out = (rows.withColumns({"at": sum0("rest"), "number": sum0(F.lit(1)), "first": (sum0("whole") / LONGEST).cast("long")})
           .join(F.broadcast(place), ["tier", "bucket"])
           .select("row", "tier", "rest", "whole", (F.col("at") + F.col("t0")).alias("at"),
                   (F.col("number") + F.col("n0")).alias("number"), (F.col("first") + F.col("w0")).alias("first")))
    return out, total


def _cells(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.withColumn("cell", F.explode(F.sequence(F.expr(f"{start} div {CELL}"), F.expr(f"({end} - 1) div {CELL}"))))


def _chunked(rows: DataFrame, length: int, first_sequence: int) -> DataFrame:
    """Cut ``(row, start, x0, x1)`` on a line into sequences of ``length``."""
    cut = rows.withColumn("k", F.explode(F.sequence(F.expr(f"x0 div {length}"), F.expr(f"(x1 - 1) div {length}"))))
    low, high = F.greatest("x0", F.col("k") * length), F.least("x1", (F.col("k") + 1) * length)
    return cut.select("row", (F.col("start") + low - F.col("x0")).alias("start"), (high - low).alias("length"),
                      (F.col("k") + first_sequence).alias("sequence_id"), (low - F.col("k") * length).alias("offset"),
                      F.lit(length).alias("tier"), F.col("k").alias("nth"))


def plan(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of all remainders, piece by piece, and the first whole window of each row, from ``(row, tokens)``."""
    rows, total = _on_lines(tokens.select("row", "tokens"))
    rows = stage(rows, "pack-plan")
    short = [t for t in sorted(total) if 0 < t < LONGEST]
    wholes = sum(w for _, _, w in total.values())
    fill_total, line0 = 0, {}
    for t in short:  # the filler line takes the shortest tier first
        line0[t], fill_total = fill_total, fill_total + total[t][0]
    long_tokens, long_n, _ = total.get(LONGEST, (0, 0, 0))

    # The gap before a window on the gap line is the windows before it less their remainders.
    windows = rows.filter(F.col("tier") == LONGEST).withColumn("g0", F.col("number") * LONGEST - F.col("at"))
    windows = windows.withColumn("g1", F.col("g0") + LONGEST - F.col("rest"))
    opened = windows.filter(F.col("g1") <= fill_total)
    n_open, x_open = opened.agg(F.count("*"), F.coalesce(F.max(F.col("at") + F.col("rest")), F.lit(0))).first()
    gaps = n_open * LONGEST - x_open
    base = F.lit(0).cast("long")
    for t in short:
        base = F.when(F.col("tier") == t, F.lit(line0[t])).otherwise(base)
    fillers = rows.filter(F.col("tier").isin(short)).withColumn("f0", F.col("at") + base)
    fillers = fillers.withColumn("f1", F.col("f0") + F.col("rest"))

    number = lambda c: (F.col(c) + wholes).alias("sequence_id")
    heads = opened.select("row", F.col("whole").alias("start"), F.col("rest").alias("length"), number("number"),
                          F.lit(0).cast("long").alias("offset"), F.lit(LONGEST).alias("tier"), (F.col("number") + wholes).alias("nth"))
    at = _cells(opened.select(F.col("number").alias("w"), F.col("rest").alias("w_rest"), "g0", "g1"), "g0", "g1")
    by = _cells(fillers.filter(F.col("f0") < gaps).select("row", "whole", "f0", F.least("f1", F.lit(gaps)).alias("f1")), "f0", "f1")
    low = F.greatest("g0", "f0", F.col("cell") * CELL)
    high = F.least("g1", "f1", (F.col("cell") + 1) * CELL)
    met = (at.join(by, "cell").filter((F.col("g0") < F.col("f1")) & (F.col("f0") < F.col("g1"))).withColumns({"low": low, "high": high})
           .filter("low < high").groupBy("row", "w").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("whole").alias("whole"),
                                     F.first("f0").alias("f0"), F.first("g0").alias("g0"), F.first("w_rest").alias("w_rest")))
    filled = met.select("row", (F.col("whole") + F.col("low") - F.col("f0")).alias("start"), (F.col("high") - F.col("low")).alias("length"),
                        number("w"), (F.col("w_rest") + F.col("low") - F.col("g0")).alias("offset"),
                        F.lit(LONGEST).alias("tier"), (F.col("w") + wholes).alias("nth"))
    # Left over: windows beyond the fillers, and of each shorter tier what lies beyond the gaps.
    rest = windows.filter(F.col("g1") > fill_total).select(
        "row", F.col("whole").alias("start"), (F.col("at") - x_open).alias("x0"), (F.col("at") - x_open + F.col("rest")).alias("x1"))
    next_id = wholes + n_open
    parts = [heads, filled, _chunked(rest, LONGEST, next_id).withColumn("nth", F.col("nth") + next_id)]
    next_id += -(-(long_tokens - x_open) // LONGEST)
    for t in short:
        begin = max(line0[t], gaps)
        left = fillers.filter((F.col("tier") == t) & (F.col("f1") > begin)).withColumn("from", F.greatest("f0", F.lit(begin)))
        parts.append(_chunked(left.select("row", (F.col("whole") + F.col("from") - F.col("f0")).alias("start"),
                                          (F.col("from") - begin).alias("x0"), (F.col("f1") - begin).alias("x1")), t, next_id))
        next_id += max(0, -(-(line0[t] + total[t][0] - begin) // t))
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    return pieces, rows.select("row", "first")


def _emit(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, ids, first, pieces in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tokens", "ids", "first", "pieces"))):
                a = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                whole = [(k * LONGEST, LONGEST, first + k, 0, LONGEST, first + k) for k in range(n // LONGEST)]
                for start, length, seq, offset, tier, nth in chain(whole, (tuple(p.values()) for p in pieces or ())):
                    rows.append((doc, start, length, zlib.crc32(a[start:start + length].tobytes()), n, seq, offset, tier,
                                 nth * tier // STEP_TOKENS))
            if rows:
                cols = list(zip(*rows))
                types = [b.column("doc_id").type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 names=[x.split()[0] for x in PIECES.format(kind=kind).split(", ")])
    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: ``PIECES``. Sequences of one tier form step groups of ``STEP_TOKENS`` tokens each.

    Token ids are written once and meet the pieces of their document in one join.
    """
    tokens = stage(tokenize(docs, tokenizer, key, text), "tokens")
    pieces, firsts = plan(tokens)
    mine = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "tier", "nth")).alias("pieces"))
    joined = tokens.join(firsts.join(mine, "row", "left"), "row").select("doc_id", "tokens", "ids", "first", "pieces")
    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(tidy(_emit(kind)), PIECES.format(kind=kind)).withColumnRenamed("doc_id", key)
