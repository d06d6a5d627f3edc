"""Benchmark passages in documents, by a prefix-filtered join and DataFrame functions only.

An item's windows are sets of word positions that a document must contain as
they stand, so one word of each is a sufficient prefix: the one that is rarest
in the documents. Documents' words meet only these prefix words; the position
of the word in its window gives where the window would begin, length and
position bounds drop what cannot fit, and the words there are compared.

Defined results: null and empty texts have no words and are clean; items
without words have no windows; null keys and repeated rows are documents of
their own; an item without id hits, but is not among the named items; empty tables give no rows or only clean ones; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import lower_ascii, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
#: Benchmark words or prefix rows are sent to all executors up to this many bytes, and joined by a shuffle beyond it.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """``(w, len, items)``: each different window, its number of words and the items that have it, as strings."""
    w = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - n + 1, F.lit(1)))
    return (w.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, F.lit(n)))).alias("w"))
            .groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("w")))


def _small(rows: DataFrame, size: Column) -> bool:
    return (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def contaminated_spans(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(row, start, len, items)`` of every occurrence of a window, from ``(row, ws)``."""
    known = windows.select(F.explode("w").alias("word")).distinct()
    small = _small(known, F.octet_length("word") + 40)
    said = docs.select(F.explode("ws").alias("word"))
    if small:  # Spark combines what survives before the shuffle
        counts = said.join(F.broadcast(known), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counts = said.groupBy("word").agg(F.count("*").alias("n")).join(known, "word")
    # For each window the rarest of its words; a word that no document has makes the window impossible.
    placed = windows.select("w", "len", "items", F.posexplode("w").alias("j", "word")).join(counts, "word", "left")
    rarest = placed.groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "word")).alias("r"),
                                     F.first("len").alias("len"), F.first("items").alias("items"))
    prefix = stage(rarest.filter("r.n > 0").select(F.col("r.word").alias("word"), F.col("r.j").alias("j"), "len", "w", "items"), "prefix")
    fits = (F.col("pos") >= F.col("j")) & (F.col("pos") - F.col("j") + F.col("len") <= F.col("n_words"))
    start = (F.col("pos") - F.col("j")).alias("start")
    same = F.slice("ws", F.col("start") + 1, F.col("len")) == F.col("w")
    if small and _small(prefix, F.aggregate(F.concat("w", "items"), F.lit(100), lambda s, x: s + F.octet_length(x) + 16)):
        at = docs.select("row", "ws", F.size("ws").alias("n_words"), F.posexplode("ws").alias("pos", "word"))
        return (at.join(F.broadcast(prefix), "word").filter(fits).select("row", "ws", start, "len", "w", "items").filter(same)
                .select("row", "start", "len", "items"))
    at = docs.select("row", F.size("ws").alias("n_words"), F.posexplode("ws").alias("pos", "word"))
    found = at.join(prefix, "word").filter(fits).select("row", start, "len", "w", "items")
    return found.join(docs, "row").filter(same).select("row", "start", "len", "items")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``(row, key, n_words, n_hit, items)`` for every document; ``items`` in order of their strings."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), words(F.col(text)).alias("ws")), "words")
    windows = stage(item_windows(items, item, item_text), "windows")
    spans = contaminated_spans(rows, windows)
    hit = spans.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("len")).alias("b")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"),
        F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    hit = hit.select("row", covered.cast("long").alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    return (rows.select("row", key, F.size("ws").cast("long").alias("n_words")).join(hit, "row", "left")
            .select("row", key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", none).alias("items")))
