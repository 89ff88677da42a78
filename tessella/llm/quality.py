"""A quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins. Trees of at most four leaves over one feature (and, after
that, of two cuts over a pair of features) are boosted in turn over the features, each round on the
gradient that all tables leave; they add up to one lookup table for each feature and chosen pair. A score
is the sigmoid of an intercept and one table entry for each, so scoring is a few array look-ups.

The model is fitted on the driver from at most ``max_rows`` labelled documents, chosen by a hash of the id
over all labelled rows (a documented bound); only their feature vectors get there. Scores are for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import SPACED, Words, blocks, encoded, sliced, trimmed
from tessella.session import bounded_batches

#: Bounds of the fitting sample, and the model's size.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "non_ascii", "space", "newline", "pipe", "symbol",
    "exclamation", "period", "comma", "other_punct", "distinct_words", "top_word", "distinct_lines", "mean_line", "distinct_bytes",
)

_SYMBOLS = [ord(c) for c in "#$%&*@^~"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text (UTF-8; empty for null). Shares are 0 where there is nothing to divide."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in blocks(texts):
        part = texts[lo:hi]
        found = Words(part, SPACED)
        counts = np.zeros((len(part), 256))
        for i, t in enumerate(part):
            counts[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        n = np.maximum(counts.sum(axis=1), 1)
        words = np.diff(found.offsets)
        lens = found.ends - found.starts
        longest, top, distinct, lines = (np.zeros(len(part)) for _ in range(4))
        for i in range(len(part)):
            a, b = int(found.offsets[i]), int(found.offsets[i + 1])
            if b > a:
                longest[i] = lens[a:b].max()
                times = np.unique(found.hashes[a:b], return_counts=True)[1]
                top[i], distinct[i] = times.max() / (b - a), len(times) / (b - a)
            all_lines = part[i].split(b"\n")
            lines[i] = len(set(all_lines)) / len(all_lines)
        share = lambda codes: counts[:, codes].sum(axis=1) / n
        letters = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123))
        other = [c for c in range(33, 127) if c not in letters and c not in _SYMBOLS and c not in map(ord, "|!.,")]
        out[lo:hi] = np.stack(
            [
                np.log1p(counts.sum(axis=1)), np.log1p(words), counts[:, 33:].sum(axis=1) / np.maximum(words, 1), longest,
                share(range(65, 91)), share(range(48, 58)), share(range(128, 256)), share([32]), share([10]), share([124]), share(_SYMBOLS),
                share([33]), share([46]), share([44]), share(other), distinct, top, lines, n / (counts[:, 10] + 1), (counts > 0).sum(axis=1),
            ],
            axis=1,
        )
    return out


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, one for each row of ``x``."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _value(g: float, h: float) -> float:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree over the bins of one feature, as a table: the best cut, and in each part the best again."""
    table = np.full(len(g), _value(g.sum(), h.sum()))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        at = int(np.argmax(gains))
        if gains[at] > _gain(g.sum(), h.sum()) + 1e-9:
            table = np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1), _tree(g[at + 1 :], h[at + 1 :], depth - 1)])
    return table


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut in each of two features, as a table, with its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    b_g, b_h = cg[:-1, -1:] - a_g, ch[:-1, -1:] - a_h
    c_g, c_h = cg[-1:, :-1] - a_g, ch[-1:, :-1] - a_h
    d_g, d_h = cg[-1, -1] - a_g - b_g - c_g, ch[-1, -1] - a_h - b_h - c_h
    gains = _gain(a_g, a_h) + _gain(b_g, b_h) + _gain(c_g, c_h) + _gain(d_g, d_h)
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    table = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            table[rows, columns] = _value(g[rows, columns].sum(), h[rows, columns].sum())
    return float(gains[i, j] - _gain(cg[-1, -1], ch[-1, -1])), table


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model for labels 0 and 1. Without rows every score is 0.5; with one label, near that label's."""
    n, positive = len(y), float(y.sum())
    model = Model(float(np.log((positive + 0.5) / (n - positive + 0.5))))
    if not n or positive in (0, n):
        return model
    d = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    bins = [np.searchsorted(model.cuts[j], x[:, j], side="right") for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(n, model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = gradient()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            total += step[bins[j]]
    # the pairs whose best tree gains most on what the single tables leave
    coarse = [np.searchsorted(model.pair_cuts[j], x[:, j], side="right") for j in range(d)]
    shapes = [len(c) + 1 for c in model.pair_cuts]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * shapes[j] + coarse[j], v, shapes[i] * shapes[j]).reshape(shapes[i], shapes[j])

    g, h = gradient()
    gains = sorted(((-_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(d) for j in range(i + 1, d)))
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradient()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on those documents whose id ``labels`` holds, at most ``max_rows`` by a hash of the id.

    Rows with a null id or label are left out; of labels that differ for one id the larger counts, and of texts
    that share an id the least. Other columns of ``docs`` (language, source, ...) are never looked at.
    """
    docs = bounded_batches(docs)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("i")).groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = features(encoded(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(trimmed(run), "y double, x array<double>").toArrow()  # one row for each id
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which tasks end
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of ``docs``; null and empty texts are scored by their features, too."""
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(features(encoded(batch.column(1)))), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with a score of at least ``least``."""
    docs = bounded_batches(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array(model.scores(features(encoded(batch.column(at)))) >= least, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
