"""Text quality by a generalised additive model with pairwise interactions.

A text is described by counts over all of its bytes, words and lines. Each
feature is cut into bins at quantiles of the fitting rows, and a table gives
the log-odds that each bin adds. The tables grow by cyclic boosting: round
after round, each feature in turn fits a tree of at most four leaves to what
is still unexplained, at a small rate. Pairs of features that explain most of
the rest get tables of two axes in the same way. A score is the sum of table
entries, looked up for a whole batch of documents at a time.

The fit uses at most ``SAMPLE`` labelled documents, those with the smallest
hash of their key. Their features are computed where the texts are; the driver
gets one row of numbers for each. Three models, each stopped where a different
third of the sample is told best, are averaged.

Defined results: null, empty and blank texts have the features of an empty
text and get a score; null keys and repeated rows are scored as they are;
labels other than 0 and 1 are no labels, and a key labelled both ways counts
as 1; with labels of one class or none every score is the share of label 1
(0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 10_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 300, 100, 0.1, 15
SMOOTH, LEAST_ROWS = 1.0, 5
FOLDS = 3

FEATURES = [
    "log_words", "word_length", "longest_word", "short_words", "upper", "digits", "high_bytes", "stops", "commas", "marks",
    "entropy", "compressed", "distinct_words", "top_word", "repeated_triples", "marked_words", "wordless", "capital_words",
    "line_length", "repeated_lines", "open_lines", "short_lines", "sentence_length", "blanks",
]
_STOPS, _COMMAS = b".!?", b",;:"
_BLANKS = b" \t\n\r\x0b\x0c"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS + _COMMAS + b"'\"-()")
_ENDS = set(".,;:!?'\")")


def features(text: str) -> list[float]:
    """The numbers that describe a whole text, in the order of FEATURES."""
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(seen[list(chars)].sum()) / n
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    p = seen[seen > 0] / n
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    triples = len(words) - 2
    lines = [x for line in text.split("\n") if (x := line.strip())]
    m = max(1, len(lines))
    letters = [w for w in counts if w[-1].isalnum() or w[-1] in _ENDS]
    return [
        np.log1p(len(words)), sum(map(len, words)) / k, float(min(100, max(map(len, counts), default=0))),
        sum(c for w, c in counts.items() if len(w) == 1) / k,
        upper / max(1, upper + lower), seen[48:58].sum() / n, seen[128:].sum() / n, share(_STOPS), share(_COMMAS), share(_MARKS),
        float(-(p * np.log2(p)).sum()) if data else 0.0, len(zlib.compress(data, 1)) / n, len(counts) / k,
        max(counts.values(), default=0) / k,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        1 - sum(counts[w] for w in letters) / k, sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / k,
        sum(c for w, c in counts.items() if w[0].isupper()) / k,
        np.log1p(len(text) / m), 1 - len(set(lines)) / m, sum(x[-1] not in ".!?" for x in lines) / m,
        sum(len(x) < 30 for x in lines) / m, np.log1p(k / max(1, seen[list(_STOPS)].sum())), share(_BLANKS),
    ]


@dataclass(frozen=True)
class Model:
    intercept: float
    edges: tuple[np.ndarray, ...] = ()
    tables: np.ndarray | None = None
    pair_edges: tuple[np.ndarray, ...] = ()
    pairs: tuple[tuple[int, int], ...] = ()
    pair_tables: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of a matrix of features: bins, then sums of table entries."""
        z = np.full(len(x), self.intercept)
        if self.tables is not None:
            for f, table in enumerate(self.tables):
                z += table[np.searchsorted(self.edges[f], x[:, f], "right")]
            for (a, b), table in zip(self.pairs, self.pair_tables):
                z += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return _share(z)


def _share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges between bins of about equal numbers of rows; equal values share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of an ordered axis; sides with few rows are no leaves."""
    gl, hl, nl = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl ** 2 / (hl + SMOOTH) + gr ** 2 / (hr + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gain, 0.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, for each bin, of a tree over one axis."""
    gain, cut = _best_cut(g, h, n) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    return np.r_[_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a cut of one axis and a cut of the other on each side, whichever axis is better first."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        _, cut = _best_cut(a.sum(1), b.sum(1), c.sum(1))
        out, gain = np.zeros_like(a), 0.0
        for side in (slice(None, cut), slice(cut, None)):
            if a[side].size:
                leaves = _tree(a[side].sum(0), b[side].sum(0), c[side].sum(0), 1)
                out[side] = leaves
                gain += float((leaves * a[side].sum(0)).sum())
        if gain > best[0]:
            best = (gain, out.T if turned else out)
    return best


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean()) if len(y) else 0.0


def _boost(cells: list[np.ndarray], shapes: list[tuple[int, ...]], y: np.ndarray, start: np.ndarray, fit: np.ndarray,
           rounds: int) -> list[np.ndarray]:
    """Tables over ``cells`` (flat bin numbers of each row) by rounds of trees, as of the round best on the other rows."""
    tables = [np.zeros(s) for s in shapes]
    best, kept, since, z = _loss(start[~fit], y[~fit]), [t.copy() for t in tables], 0, start.copy()
    rows = [np.bincount(c[fit], minlength=t.size) for c, t in zip(cells, tables)]
    for _ in range(rounds):
        for c, t, n in zip(cells, tables, rows):
            p = _share(z[fit])
            g = np.bincount(c[fit], y[fit] - p, t.size).reshape(t.shape)
            h = np.bincount(c[fit], p * (1 - p), t.size).reshape(t.shape)
            step = RATE * (_tree(g, h, n) if t.ndim == 1 else _pair_tree(g, h, n.reshape(t.shape))[1])
            t += step
            z += step.ravel()[c]
        now = _loss(z[~fit], y[~fit])
        if now < best - 1e-6:
            best, kept, since = now, [t.copy() for t in tables], 0
        elif (since := since + 1) >= PATIENCE:
            break
    return kept


def fit_model(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on a matrix of features and labels 0 and 1."""
    share = y.mean() if len(y) else 0.5
    base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if len(y) < 2 * FOLDS or share in (0.0, 1.0):
        return Model(base)
    columns = range(x.shape[1])
    edges, pair_edges = (tuple(_edges(x[:, f], b) for f in columns) for b in (BINS, PAIR_BINS))
    cells = [np.searchsorted(edges[f], x[:, f], "right") for f in columns]
    coarse = [np.searchsorted(pair_edges[f], x[:, f], "right") for f in columns]
    of_fold = [np.arange(len(y)) % FOLDS != k for k in range(FOLDS)]
    start = np.full(len(y), base)
    singles = [_boost(cells, [(BINS,)] * len(cells), y, start, fit, ROUNDS) for fit in of_fold]
    tables = np.mean(singles, axis=0)
    z = start + sum(t[c] for t, c in zip(tables, cells))
    p = _share(z)
    flat = {(a, b): coarse[a] * PAIR_BINS + coarse[b] for a, b in combinations(columns, 2)}
    shape = (PAIR_BINS, PAIR_BINS)
    hist = lambda c, w=None: np.bincount(c, w, PAIR_BINS ** 2).reshape(shape)
    gains = {ab: _pair_tree(hist(c, y - p), hist(c, p * (1 - p)), hist(c))[0] for ab, c in flat.items()}
    pairs = tuple(sorted(gains, key=lambda ab: (-gains[ab], ab))[:PAIRS])
    doubles = [_boost([flat[ab] for ab in pairs], [shape] * len(pairs), y,
                      start + sum(t[c] for t, c in zip(single, cells)), fit, PAIR_ROUNDS)
               for single, fit in zip(singles, of_fold)]
    return Model(base, edges, tables, pair_edges, pairs, np.mean(doubles, axis=0))


def _described(docs: DataFrame, key: str, text: str, extra: str | None = None) -> DataFrame:
    """Key, features and, if named, one more column of every row, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64())), *b.columns[2:]],
                                             names=["k", "x", *b.schema.names[2:]])

    of = lambda c: f"`{c}` {docs.schema[c].dataType.simpleString()}"
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, *([extra] if extra else [])).mapInArrow(
        run, f"k {kind}, x array<double>" + (f", {of(extra)}" if extra else ""))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` of the labelled rows given; nothing but their texts is looked at."""
    known = (labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
             .groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample))
    # Broadcast: at most `sample` ids.
    texts = (docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k"))
    rows = _described(texts, "k", "t", "y").groupBy("k", "x", "y").count().orderBy(F.xxhash64("k"), "k", "x").limit(2 * sample).collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_model(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(1)], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
