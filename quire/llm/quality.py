"""Quality classifier: an additive model of lookup tables with pairwise interactions.

Each feature is cut into quantile bins. Cyclic boosting visits the features in turn and fits a
shallow tree over the bins to the current residual; its leaves are added to that feature's table.
Then the pairs of features with most gain get two-dimensional tables in the same way. A score is
the sum of table entries, looked up for a whole batch at a time.

The model is fitted on a bounded sample of labelled rows (``most_rows``, 20 000 by default);
scoring is one pass over the whole texts without a shuffle. Label, language, source and id are
never features.

Defined results: null and empty texts get the score of their (zero) features; without labels the
score is 0.5 for all; repeated rows are scored alike; an empty table gives no rows; other columns
are ignored by ``score`` and passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import TextBatch, lean, small_batches, table
from quire.llm.labels import held_out, training_rows

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "symbols", "digits", "stops", "distinct_words", "echoed_words", "distinct_lines", "lines_per_word", "lone_symbols")
_KIND = np.zeros(256, np.uint8)  # 0 letters and others, 1 upper, 2 symbol, 3 digit, 4 sentence mark, 5 white space
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 2
_KIND[48:58], _KIND[65:91] = 3, 1
_KIND[list(b".,;:?'")] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def features(texts: TextBatch) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in texts.groups(1 << 20):
        base = texts.bounds[a]
        kinds = _KIND[texts.bytes[base : texts.bounds[b]]]
        ends = texts.bounds[a : b + 1] - base
        share = {}
        for kind in (1, 2, 3, 4):
            run = np.concatenate(([0], np.cumsum(kinds == kind, dtype=np.int64)))
            share[kind] = (run[ends[1:]] - run[ends[:-1]]) / np.maximum(1, np.diff(ends))
        out[a:b, 0] = np.log1p(np.diff(ends))
        for column, kind in ((3, 1), (4, 2), (5, 3), (6, 4)):
            out[a:b, column] = share[kind]
        for i in range(a, b):
            text = texts.text(i)
            words, lines = text.split(), text.split(b"\n")
            n = len(words)
            if n:
                out[i, 1] = np.log1p(n)
                out[i, 2] = len(text) / n
                out[i, 7] = len(set(words)) / n
                out[i, 8] = sum(map(eq, words, words[1:])) / n
                out[i, 9] = len(set(lines)) / len(lines)
                out[i, 10] = len(lines) / n
                out[i, 11] = words.count(b"|") / n
    return out


@dataclass
class AdditiveModel:
    """Intercept, bin edges and tables; pairs share coarser edges."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], side="right")]
        bins = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for i, j, _ in self.pairs for k in (i, j)}
        for i, j, values in self.pairs:
            total += values[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf value of each bin for the best shallow tree over ordered bins (sums by bin)."""
    value = np.full(len(grad), grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(grad) < 2:
        return value
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1)
    gain[(h < least) | (hess.sum() - h < least)] = -np.inf
    cut = int(gain.argmax()) + 1
    if not np.isfinite(gain[cut - 1]) or gain[cut - 1] <= grad.sum() ** 2 / (hess.sum() + 1) + 1e-9:
        return value
    return np.concatenate((_tree(grad[:cut], hess[:cut], depth - 1, least), _tree(grad[cut:], hess[cut:], depth - 1, least)))


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of both axes and the leaf values of its four quadrants."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(grad)
    corner = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gain = sum(a**2 / (b + 1) for a, b in zip(corner(g), corner(h), strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(grad)
    parts = [a[i, j] / (b[i, j] + 1) for a, b in zip(corner(g), corner(h), strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = parts
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, depth: int = 2) -> AdditiveModel:
    """Fit by cyclic boosting. No rows: an intercept of 0, so every score is 0.5."""
    d = x.shape[1]
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(mean / (1 - mean)))
    edges, coarse = [_edges(x[:, k], bins) for k in range(d)], [_edges(x[:, k], coarse_bins) for k in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y):
        return AdditiveModel(start, edges, tables, coarse, [])
    codes = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    total = np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(d):
            grad, hess = slopes()
            step = rate * _tree(np.bincount(codes[k], grad, len(tables[k])), np.bincount(codes[k], hess, len(tables[k])), depth, 1.0)
            tables[k] += step
            total += step[codes[k]]
    small = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    flat = {(i, j): small[i] * (len(coarse[j]) + 1) + small[j] for i in range(d) for j in range(i + 1, d)}
    shape = {(i, j): (len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in flat}
    both = lambda ij, w: np.bincount(flat[ij], w, shape[ij][0] * shape[ij][1]).reshape(shape[ij])
    grad, hess = slopes()
    best = sorted(flat, key=lambda ij: (-_quadrants(both(ij, grad), both(ij, hess))[0], ij))[:n_pairs]
    pair_tables = {ij: np.zeros(shape[ij]) for ij in best}
    for _ in range(pair_rounds):
        for ij in best:
            grad, hess = slopes()
            step = rate * _quadrants(both(ij, grad), both(ij, hess))[1]
            pair_tables[ij] += step
            total += step.ravel()[flat[ij]]
    return AdditiveModel(start, edges, tables, coarse, [(i, j, t) for (i, j), t in pair_tables.items()])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Features of the sample are made in Spark; only their bounded matrix reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(TextBatch(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(c) for c in x.T)], names=["y", *FEATURES])

    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, label, most_rows, id_col, text_col).mapInArrow(lean(run), "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    sample = sample.sort_values(list(FEATURES) + ["y"])  # the order of rows must not matter
    return fit(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(features(TextBatch(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(lean(run), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(features(TextBatch(batch.column(place)))) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
