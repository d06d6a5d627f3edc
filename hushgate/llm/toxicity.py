"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text, another on what toxic
text has more of. A window of text is compressed with the ordinary dictionary
alone and with both; the bytes saved say how toxic it reads. The savings of
all windows of a document become a score by a logistic fit on other documents.

What toxic text has more of: words that follow and precede many different
words in toxic samples, at several times their rate in ordinary samples.
Counting neighbours, not documents, keeps copies of one text from counting
twice. Short chance matches are shut out by the minimum match length.

The dictionaries and the fit use a bounded sample: at most ``SAMPLE``
documents of each class for the dictionaries and as many again for the fit,
none over ``SAMPLE_BYTES``, those with the smallest hash of their id, and of
their windows at most ``DICT_WINDOWS`` for each dictionary. Scoring reads
every window of every text.

Defined results: null and empty texts have one empty window and get the score
of a text without savings; null keys and repeated rows are scored as they are;
labels that are null are no labels; without both classes every score is the
share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushgate.llm.common import once_a_task, small_batches, stage, tidy

WINDOW = 64
SAMPLE, SAMPLE_BYTES = 2500, 32 << 10
#: Windows that train a dictionary, and tasks that read the sample.
DICT_WINDOWS, SAMPLE_TASKS = 40_000, 24
ORDINARY_DICT, TOXIC_DICT = 8192, 2048
#: A mark has so many different pairs of neighbours, at so many times the ordinary rate.
LEAST_NEIGHBOURS, LEAST_RATE = 6, 5.0
MIN_MATCH = 5
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    """The whole text in windows of at most WINDOW bytes, cut at blanks where there are any."""
    b, out, i = text.lower().encode("utf-8", "replace"), [], 0
    while len(b) - i > WINDOW:
        j = b.rfind(b" ", i + WINDOW // 2, i + WINDOW)
        j = i + WINDOW if j < 0 else j
        out.append(b[i:j])
        i = j
    return [*out, b[i:]]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=MIN_MATCH, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT),
                             compression_params=params)


class Scorer:
    def __init__(self, model: Model):
        self.ordinary, self.both = _compressor(model.ordinary), _compressor(model.ordinary + model.toxic)
        self.weights = np.array(model.weights)

    def features(self, text: str) -> np.ndarray:
        one, two = self.ordinary.compress, self.both.compress
        saved = np.array([len(one(w)) - len(two(w)) for w in windows(text)], float)
        strong = np.maximum(saved - 2, 0)
        return np.array([1.0, min(saved.max(), 12), min(strong.sum(), 40), np.maximum(saved, 0).mean(), strong.mean(),
                         (saved >= 5).mean(), np.log1p((saved >= 4).sum()), np.log(len(saved))])

    def score(self, text: str) -> float:
        z = float(np.clip(self.features(text) @ self.weights, -30, 30))
        return 1 / (1 + np.exp(-z))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zs.train_dictionary(size, samples, level=3).as_bytes()
    except zs.ZstdError:  # too few samples to choose from
        return b"".join(samples)[:size].ljust(8, b" ")


def _words_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(y, words, neighbours)`` of each text: its words, and what stands before and after each."""
    for b in batches:
        for t, y in zip(b.column(0), b.column(1)):
            words = ["", *_WORD.findall(t.as_py().lower()), ""]
            around = [f"{x} {z}" for x, z in zip(words, words[2:])]
            yield pa.RecordBatch.from_arrays([pa.array([y.as_py()], pa.int32()), pa.array([words[1:-1]], pa.list_(pa.string())),
                                              pa.array([around], pa.list_(pa.string()))], names=["y", "w", "ab"])


def mark_words(samples: DataFrame) -> set[str]:
    """Words of ``samples(t, y)`` that toxic texts use among many and at several times the ordinary rate."""
    seen = (samples.select("t", "y").mapInArrow(_words_between, "y int, w array<string>, ab array<string>")
            .select("y", F.explode(F.arrays_zip("w", "ab")).alias("p"))
            .select("y", F.col("p.w").alias("w"), F.xxhash64("p.ab").alias("h")).distinct())
    counts = stage(seen.groupBy("w").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("o")), "toxicity-words")
    total = counts.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    texts = samples.filter("y = 1").count()
    least, rate = min(LEAST_NEIGHBOURS, max(2, texts // 10)), LEAST_RATE * max(1, total.t or 0) / max(1, total.o or 0)
    return {r.w for r in counts.filter((F.col("t") >= least) & (F.col("t") > rate * (F.col("o") + 1))).select("w").collect()}


def _some_windows(samples: DataFrame, of: Callable[[str], list[bytes]]) -> list[bytes]:
    """At most DICT_WINDOWS of the windows that ``of`` makes of each text, those with the smallest hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(of(t.as_py()), pa.binary())], names=["w"])

    picked = samples.select("t").mapInArrow(tidy(run), "w binary").orderBy(F.xxhash64("w"), "w").limit(DICT_WINDOWS)
    return picked.toArrow()["w"].to_pylist()


def train_dictionaries(samples: DataFrame) -> tuple[bytes, bytes]:
    """Of ``samples(t, y)``: an ordinary dictionary, and one of what toxic texts have more of."""
    marks = mark_words(samples)

    def marked(text: str) -> list[bytes]:
        found = ([x for x in _WORD.findall(w.decode("utf-8", "ignore")) if x in marks] for w in windows(text))
        return [f" {' '.join(f)} ".encode() for f in found if f]

    return (_dictionary(_some_windows(samples.filter("y = 0"), windows), ORDINARY_DICT),
            _dictionary(_some_windows(samples.filter("y = 1"), marked), TOXIC_DICT))


def fit_weights(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, ...]:
    """Logistic regression by Newton steps, each class weighted to its share in all labels."""
    w, c = np.zeros(x.shape[1]), np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (c * (y - p)) - 1e-2 * w)
    return tuple(w)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows given.

    Texts stay on the executors: the driver gets word lists, at most DICT_WINDOWS
    windows for each dictionary, and eight numbers for each fitting text.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # Broadcast: at most four samples of ids; twice what is used because of long texts among them.
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(2 * sample) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(
        F.octet_length("t").between(1, SAMPLE_BYTES)).join(F.broadcast(picked[0].unionByName(picked[1])), "k")
    once = texts.groupBy("t").agg(F.max("y").alias("y"), F.min("k").alias("k"))
    # Numbered within a class: at most two samples of rows. Two thirds are for the dictionaries.
    rows = stage(once.select("t", "y", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k", "t")).alias("i")), "toxicity-sample")
    of = [rows.filter((F.col("i") % 3 == 0) if fitting else (F.col("i") % 3 != 0)).filter(F.col("i") <= 3 * sample // (1 if fitting else 2))
          .repartition(SAMPLE_TASKS, F.xxhash64("t")) for fitting in (False, True)]
    if rows.filter("i >= 3").select("y").distinct().count() < 2:
        flat = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Model(b"no model", b"no model", (flat, *[0.0] * 7))
    base, extra = train_dictionaries(of[0])
    plain = Model(base, extra, (0.0,) * 8)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plain)
        for b in batches:
            x = [scorer.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    with small_batches(docs.sparkSession):
        fit = of[1].select("t", "y").mapInArrow(tidy(describe), "y int, x array<double>").orderBy("y", "x").collect()
    return Model(base, extra, fit_weights(np.array([r.x for r in fit]), np.array([r.y for r in fit]), share))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            values = [scorer.score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, score double")


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores below ``threshold``."""
    scorer = once_a_task(__name__, lambda: Scorer(model))

    @F.udf("boolean", useArrow=False)
    def below(value: str | None) -> bool:
        return bool(scorer().score(value or "") < threshold)

    return docs.filter(below(F.col(text).cast("string")))
