"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; its table gives the bin's addend. Tables are learned by cyclic boosting: round by round, one shallow
tree for each feature in turn is fitted to what is left of the gradient, and added to the feature's table. The pairs of features whose joint bins
hold most of what the tables can't give then get tables of their own, in the same way. A score is a sum of look-ups through the logistic function.

Features are of the text alone. Fitting takes at most ``SAMPLE`` labelled rows (those of the lowest hash of their id), which are held by the driver.
The tables have a fixed size and are sent to every task.

A null text is an empty one, and is scored like any other. Without labels of both kinds the score is their mean, or 0.5 without any.
Null labels aren't learned; repeated rows count again. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE, BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE, LEAF = 50_000, 32, 8, 80, 6, 30, 0.15, 5.0, 10
FEATURES = (
    "ln_bytes",
    "ln_words",
    "mean_word",
    "spread_word",
    "short_words",
    "upper",
    "symbols",
    "digits",
    "stops",
    "calls",
    "lines",
    "longest_line",
    "repeated_lines",
    "distinct_words",
    "beyond_ascii",
    "other_marks",
)
_CLASSES = [
    [65 <= b <= 90 for b in range(256)],
    [b in b"#*$%&|<>" for b in range(256)],
    [48 <= b <= 57 for b in range(256)],
    [b in b".,;:" for b in range(256)],
    [b in b"!?" for b in range(256)],
    [b >= 128 for b in range(256)],
    [33 <= b <= 126 and not chr(b).isalnum() and b not in b"#*$%&|<>.,;:!?" for b in range(256)],
]
_CLASS = np.array(_CLASSES, float).T
_LINE = np.arange(256) != 10


def features(col: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = []
    for _, _, data, offs in C.chunks(col):
        s, e, first = C.word_bounds(data, offs, C.BLANK_WORD)
        h = C.word_hashes(C.LOWER[data], s, e)
        ls, le, lfirst = C.word_bounds(data, offs, _LINE)
        lh = C.word_hashes(data, ls, le)
        rows = np.zeros((len(offs) - 1, len(FEATURES)))
        for i in range(len(rows)):
            a, b = offs[i], offs[i + 1]
            w = slice(first[i], first[i + 1])
            n = first[i + 1] - first[i]
            if not n:
                continue
            line = slice(lfirst[i], lfirst[i + 1])
            m = lfirst[i + 1] - lfirst[i]
            size = (e[w] - s[w]).astype(float)
            share = np.bincount(data[a:b], minlength=256) @ _CLASS / size.sum()
            rows[i] = [
                np.log1p(b - a),
                np.log1p(n),
                size.mean(),
                size.std(),
                (size <= 3).mean(),
                *share[:3],
                share[3] * size.mean(),
                share[4] * size.mean(),
                m / n,
                (le[line] - ls[line]).max() / (b - a),
                1 - len(np.unique(lh[line])) / m,
                len(np.unique(h[w])) / n,
                *share[5:],
            ]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for j, k, table in self.pairs:
            total += table[np.searchsorted(self.coarse[j], x[:, j], "right"), np.searchsorted(self.coarse[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between bins of about equal counts; a value that many rows share has a bin of its own."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best cut of bins in two: its gain and the first bin on the right, 0 for none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < LEAF) | (n.sum() - nl < LEAF)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over bins: each bin's leaf value."""
    _, cut = _split(g, h, n) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same over a grid: a cut of the rows, and each side's own cut of the columns."""
    best, out = -1.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE))
    for cut in range(1, len(g)):
        sides = [(slice(0, cut), _split(g[:cut].sum(0), h[:cut].sum(0), n[:cut].sum(0))), (slice(cut, None), _split(g[cut:].sum(0), h[cut:].sum(0), n[cut:].sum(0)))]
        gain = sum(x[0] for _, x in sides)
        if gain > best:
            best, out = gain, np.zeros(g.shape)
            for rows, (_, k) in sides:
                for cols in (slice(0, k), slice(k, None)):
                    out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))))
    d = x.shape[1]
    m = Model(float(np.log(y.mean() / (1 - y.mean()))), [_edges(x[:, j], BINS) for j in range(d)])
    at = [np.searchsorted(m.edges[j], x[:, j], "right") for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(len(y), m.base)
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(at, m.tables, strict=True)]
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-total))
            k = len(m.tables[j])
            step = RATE * _tree(np.bincount(at[j], y - p, k), np.bincount(at[j], p * (1 - p), k), counts[j], 2)
            m.tables[j] += step
            total += step[at[j]]
    m.coarse = [_edges(x[:, j], COARSE) for j in range(d)]
    wide = [np.searchsorted(m.coarse[j], x[:, j], "right") for j in range(d)]
    p = 1 / (1 + np.exp(-total))

    def grid(j: int, k: int, p: np.ndarray) -> list[np.ndarray]:
        shape = (len(m.coarse[j]) + 1, len(m.coarse[k]) + 1)
        cell = wide[j] * shape[1] + wide[k]
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p), np.ones(len(y)))]

    gains = []
    for j in range(d):
        for k in range(j + 1, d):
            g, h, _ = grid(j, k, p)
            gains.append((float((g**2 / (h + RIDGE)).sum() - (g.sum(0) ** 2 / (h.sum(0) + RIDGE)).sum() - (g.sum(1) ** 2 / (h.sum(1) + RIDGE)).sum()), j, k))
    chosen = [(j, k) for gain, j, k in sorted(gains, key=lambda t: (-t[0], t[1:])) if gain > 0][:PAIRS]
    m.pairs = [(j, k, np.zeros((len(m.coarse[j]) + 1, len(m.coarse[k]) + 1))) for j, k in chosen]
    for _ in range(PAIR_ROUNDS):
        for j, k, table in m.pairs:
            step = RATE * _pair_tree(*grid(j, k, 1 / (1 + np.exp(-total))))
            table += step
            total += step[wide[j], wide[k]]
    return m


def with_features(docs: DataFrame) -> DataFrame:
    """The columns beside text, and x, an array of FEATURES."""
    rest = [c for c in docs.columns if c != "text"]
    slim = docs.select(*rest, F.col("text").cast("binary").alias("text"))
    schema = T.StructType([*[slim.schema[c] for c in rest], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(len(rest)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=schema.names)

    return C.map_arrow(slim, run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """labels: key and quality (0 or 1) of the rows to learn from."""
    chosen = labels.where("quality IN (0, 1)").select(F.col(key).alias("_key"), "quality").orderBy(F.xxhash64("_key"), "_key", "quality").limit(sample)
    found = docs.select(key, "text").join(F.broadcast(chosen), F.col(key) == F.col("_key")).select("_key", "text", "quality")
    rows = with_features(found).orderBy(F.xxhash64("_key"), "_key", "quality", "x").limit(sample).orderBy("quality", "x").collect()  # also of repeated documents no more than sample
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], float))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, score and predicted of each document."""
    slim = docs.select(F.col(key), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([slim.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return C.map_arrow(slim, run, schema)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id") -> DataFrame:
    return score(docs, train(docs, labels.where(learn), key=key), key)


def op3_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    held_out = C.fold("doc_id", 3) == 1
    return classify(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")
