"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, digits and
signs that stand for letters to those letters, everything else that is no letter to one space.
The automaton then finds lexicon entries (whole words or word beginnings); a hit inside an
exception phrase does not count, and of several entries at one word the heaviest does. Sums are
normalised by length and turned into a score by a fitted logistic curve.

Weights (smoothed log odds), exceptions and the curve are learnt from a bounded sample of labelled
rows (``most_rows``, 20 000 by default); the lexicon has ``most_entries`` entries at most. Scoring
is one pass over whole texts without a shuffle.

Defined results: null and empty texts have no hits and get the score of no hits; without labels
the lexicon is empty; repeated rows are scored alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import lean, small_batches, table, written
from quire.llm.labels import held_out, training_rows

#: Look-alikes of Latin letters, then digits and signs used for letters.
_PAIRS = (
    "аa вb сc ԁd еe һh іi јj кk ӏl мm ոn оo рp ԛq гr ѕs тt սu ѵv ԝw хx уy "
    "αa βb εe ιi κk νv οo ρp τt υu χx ɑa ɡg ıi ſs 0o 1i 3e 4a 5s 7t @a"
)
FOLDS = {ord(p[0]): p[1] for p in _PAIRS.split()} | {0xFF01 + k: chr(0x21 + k) for k in range(94) if chr(0x21 + k).isalpha()}
_SIGN = re.compile(r"(?<=\w)[$](?=\w)")
_GAP = re.compile(r"[\W_]+")
SPANS = range(4, 9)


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    low = (text or "").lower().translate(FOLDS)
    if "$" in low:
        low = _SIGN.sub("s", low)
    return f" {_GAP.sub(' ', low).strip()} "


def entries_of(word: str) -> Iterator[str]:
    """Lexicon entries that a word can support: its beginnings and itself."""
    for n in SPANS:
        if len(word) >= n:
            yield f" {word[:n]}"
    if len(word) >= 3:
        yield f" {word} "


@dataclass
class ToxicModel:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, None))
        for phrase in self.exceptions:
            _, w, _ = found.get(phrase, (0, 0.0, None))
            found.add_word(phrase, (len(phrase), w, phrase.count(" ") > 2))
        found.make_automaton()
        return found


def hits(found: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """Weight of each word that is hit, by its place, without those in exception phrases."""
    at: dict[int, float] = {}
    if found is None:
        return at
    spared: list[tuple[int, int]] = []
    for end, (size, weight, phrase) in found.iter(folded):
        start = end - size + 1
        if phrase:
            spared.append((start, end))
        if weight > at.get(start, 0.0):
            at[start] = weight
    for start, end in spared:
        for k in [k for k in at if start <= k < end]:
            del at[k]
    return at


def measures(found, folded: str) -> tuple[float, float, float]:
    """Log of the summed weights, that sum by length, and the heaviest hit."""
    at = hits(found, folded)
    total = sum(at.values())
    return float(np.log1p(total)), total / (folded.count(" ") + 10.0) * 10, max(at.values(), default=0.0)


def _count(sample: DataFrame, make) -> DataFrame:
    """(entry, pos, neg): documents of either label that hold an entry, combined by batch first.

    ``make`` gives a task its function from a folded text to its set of entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = make()
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                counts[y].update(entries(fold(text)))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], names=["entry", "pos", "neg"])

    return sample.mapInArrow(lean(run), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 20_000, most_entries: int = 5_000, least_docs: int = 6, least_weight: float = 1.5, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    small_batches(docs.sparkSession)
    sample = written(training_rows(docs, labels, label, most_rows, id_col, text_col), "toxic-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return ToxicModel({})
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    counted = _count(sample, lambda: lambda t: {e for w in set(t.split()) for e in entries_of(w)}).where(F.col("pos") >= least_docs)
    chosen = counted.withColumn("w", weight).where(F.col("w") >= least_weight).orderBy(F.desc(F.col("w") * F.sqrt("pos")), "entry").limit(most_entries)
    model = ToxicModel({r["entry"]: float(r["w"]) for r in chosen.collect()})
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def contexts():
        found = shared.value.automaton()

        def around(folded: str) -> set[str]:
            out = set()
            for start in hits(found, folded):
                left = folded.rfind(" ", 0, start)
                stop = folded.find(" ", start + 1)
                right = folded.find(" ", stop + 1)
                if left >= 0:
                    out.add(folded[left : stop + 1])
                if right >= 0:
                    out.add(folded[start : right + 1])
            return out

        return around

    # a context in which a hit says nothing about the label is no hit; their number is bounded by
    # the sample, as each is held by ``least_docs`` rows of it
    phrases = _count(sample, contexts).where((F.col("neg") >= least_docs) & (weight <= 0.5)).orderBy(F.desc("neg"), "entry")
    model = ToxicModel(model.weights, [r["entry"] for r in phrases.collect()])
    final = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = final.value.automaton()
        for batch in batches:
            m = np.array([measures(found, fold(t)) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(c) for c in m.T)], names=["y", "a", "b", "c"])

    rows = sample.mapInArrow(lean(run), "y int, a double, b double, c double").toPandas().sort_values(["a", "b", "c", "y"])
    return ToxicModel(model.weights, model.exceptions, _logistic(rows[["a", "b", "c"]].to_numpy(float), rows["y"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps for a ridge logistic curve: intercept, then one slope for each column."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, b = shared.value.automaton(), np.array(shared.value.curve)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                m = np.array([measures(found, fold(t)) for t in part.column("text").to_pylist()]).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(b[0] + m @ b[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(lean(run), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
