"""Embedding whitening: streamed moments, merged over partitions, and a symmetric QR eigen-solve.

1. Each task runs over its vectors in batches and keeps count, exact sums, mean and centred second
   moments. Within a batch Welford's rank-one updates (x - mean before) (x - mean after)^T are
   added as one matrix product over the running means.
2. The states of tasks, one of d x d numbers each, are merged by the parallel update formula in a
   tree of tasks that hold two states at a time.
3. The covariance, d x d numbers, is reduced to tridiagonal form by reflections and solved by
   implicitly shifted QR steps on the driver.
4. A second pass projects every vector on the leading components; moments of what comes out, kept
   the same way, tell how far its covariance is from the identity.

Entries are x = floor(1024 c) + 100000. Defined results: vectors that are null or hold null or
non-finite entries are dropped, as are empty ones; vectors of different lengths are fitted apart, each
length as a table of its own, so ``n`` and all moments are of a row's own length; there are as many components
as entries where those are fewer than ``most``; a component without spread (its eigenvalue at most
1e-12 of the trace, as with a single or constant vector, or where second moments overflow a double) gives ``whitened`` 0 and stays out of
``identity_error``, which is 0 where no component has spread; ``explained`` is 0 where the trace is 0;
``deviation`` is exact and null where it does not fit into a long or an entry is 2^31 or more; rows
that repeat an id are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import lean, table, written

SHIFT, SCALE = 100_000, 1024
EXACT = 1 << 31
#: Tasks that merge states side by side before one merges theirs.
FAN = 16
STATE = "d int, n long, total array<long>, exact boolean, mean array<double>, m2 array<double>"


@dataclass
class Moments:
    """Count, exact sums of x, and mean and centred second moments of x - SHIFT."""

    n: int
    total: np.ndarray
    exact: bool
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, np.int64), True, np.zeros(d), np.zeros((d, d)))

    def add(self, y: np.ndarray) -> None:
        """Welford's update by each row of ``y`` in turn, summed as one product."""
        if not len(y):
            return
        count = self.n + np.arange(1, len(y) + 1)[:, None]
        first = y - self.mean  # deviations from the mean before the batch
        with np.errstate(over="ignore", invalid="ignore"):
            after = self.mean + np.cumsum(first, axis=0) / count
            before = np.vstack([self.mean[None], after[:-1]])
            self.m2 += (y - before).T @ (y - after)
        self.mean, self.n = after[-1], self.n + len(y)

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        if not other.n:
            return
        n = self.n + other.n
        gap = other.mean - self.mean
        self.m2 += other.m2 + np.outer(gap, gap) * (self.n / n * other.n)
        self.mean = self.mean + gap * (other.n / n)
        self.exact = self.exact and other.exact and _fits(self.total, other.total)
        self.total = self.total + other.total if self.exact else self.total
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * max(1, self.n))


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(np.all(np.abs(a.astype(float) + b.astype(float)) < 2.0**62))


def entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, y = x - SHIFT as doubles) for each vector length of an array<double> column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    with np.errstate(over="ignore"):
        y = np.floor(flat * float(SCALE))
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield rows, y[(ends[rows] - d)[:, None] + np.arange(d)]


def _record(states: dict[int, Moments]) -> pa.RecordBatch:
    kept = [s for _, s in sorted(states.items())]
    columns = (
        pa.array(sorted(states), pa.int32()), pa.array([s.n for s in kept], pa.int64()), pa.array([s.total.tolist() for s in kept], pa.list_(pa.int64())),
        pa.array([s.exact for s in kept], pa.bool_()), pa.array([s.mean.tolist() for s in kept], pa.list_(pa.float64())), pa.array([s.m2.ravel().tolist() for s in kept], pa.list_(pa.float64())),
    )
    return pa.RecordBatch.from_arrays(list(columns), names=["d", "n", "total", "exact", "mean", "m2"])


def _states(batch: pa.RecordBatch) -> Iterator[tuple[int, Moments]]:
    for k in range(batch.num_rows):
        r = batch.slice(k, 1)
        d = r.column("d")[0].as_py()
        at = lambda c: r.column(c).flatten().to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
        yield d, Moments(r.column("n")[0].as_py(), at("total"), r.column("exact")[0].as_py(), at("mean"), at("m2").reshape(d, d))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Moments] = {}
    for batch in batches:
        for d, state in _states(batch):
            if d in held:
                held[d].merge(state)
            else:
                held[d] = state
    if held:
        yield _record(held)


def gathered(rows: DataFrame, read: Callable[[pa.RecordBatch, dict[int, Moments]], None]) -> dict[int, Moments]:
    """Moments by length: ``read`` adds a batch to a task's states; a tree of tasks merges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            read(batch, held)
        if held:
            yield _record(held)

    states = rows.mapInArrow(lean(run), STATE)
    for tasks in (FAN, 1):
        states = states.repartition(tasks).mapInArrow(_merged, STATE)
    # one state for each length of vector: bounded by d x d
    return {r["d"]: Moments(r["n"], np.array(r["total"]), r["exact"], np.array(r["mean"]), np.array(r["m2"]).reshape(r["d"], r["d"])) for r in states.collect()}


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) of q^T v q, by Householder reflections."""
    a, n = v.copy(), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        top = float(np.abs(x).max())
        if top == 0.0:
            continue
        x /= top  # squares of tiny numbers would lose digits
        x[0] += math.copysign(math.sqrt(float(x @ x)), x[0])
        x /= math.sqrt(float(x @ x))
        part = a[k + 1 :, k + 1 :]
        p = part @ x
        w = p - (x @ p) * x
        part -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(v: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix.

    QR steps with Wilkinson's shift chase a bulge down the tridiagonal form by plane rotations.
    """
    n = len(v)
    scale = float(np.abs(v).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(n), np.eye(n)
    d, e, q = tridiagonal(v / scale)
    q = np.ascontiguousarray(q.T)  # rotations work on rows
    hi, steps = n - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= np.finfo(float).eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi, steps = hi - 1, 0
            continue
        if steps == most_steps:
            raise ArithmeticError("eigenvalues did not settle")
        steps += 1
        gaps = np.flatnonzero(small)
        lo = int(gaps[-1]) + 1 if len(gaps) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a, b, g = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a + 2 * c * s * g + s * s * b, s * s * a - 2 * c * s * g + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * g
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, q[order].T


@dataclass
class Whitening:
    """What maps vectors of one length: centre, loadings over sqrt(eigenvalue), shares of the trace."""

    n: int
    total: np.ndarray
    exact: bool
    mean: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray
    spread: np.ndarray

    @classmethod
    def fitted(cls, m: Moments, most: int) -> Whitening:
        v = m.covariance()
        if not np.isfinite(v).all():
            v = np.zeros_like(v)
        trace = float(np.trace(v))
        values, vectors = eigen(v)
        values, vectors = values[:most], vectors[:, :most]
        spread = values > 1e-12 * trace
        scale = np.where(spread, 1 / np.sqrt(np.where(spread, values, 1.0)), 0.0)
        return cls(m.n, m.total, m.exact, m.mean, vectors * scale, np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values)), spread)

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ self.loadings if self.spread.any() else np.zeros((len(y), len(self.spread)))

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact."""
        ok = np.abs(y).max(axis=1) < EXACT
        if not self.exact:
            return [None] * len(y)
        part = self.n * (np.where(ok[:, None], y, 0).astype(np.int64) + SHIFT) - self.total
        rough = (part.astype(float) ** 2).sum(axis=1)
        sure = rough < 2.0**62
        exact = (np.where(sure[:, None], part, 0) ** 2).sum(axis=1).tolist()
        for k in np.flatnonzero(~sure & ok & (rough < 2.0**64)):
            exact[k] = sum(int(x) ** 2 for x in part[k])
        return [x if yes and approx < 2.0**64 and x < 1 << 63 else None for x, yes, approx in zip(exact, ok, rough, strict=True)]


def finite(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that can be fitted."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def _add(states: dict[int, Moments], y: np.ndarray, exact: bool = True) -> None:
    state = states.setdefault(y.shape[1], Moments.empty(y.shape[1]))
    for k in range(0, len(y), 1000):
        state.add(y[k : k + 1000])
    if exact:
        state.exact = state.exact and bool(np.abs(y).max() < EXACT)
        whole = (y.astype(np.int64) + SHIFT).sum(axis=0) if state.exact else state.total
        state.exact = state.exact and _fits(state.total, whole)
        state.total = state.total + whole if state.exact else state.total


def fit(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Whitening]:
    """The whitening of each vector length in the table."""

    def read(batch: pa.RecordBatch, states: dict[int, Moments]) -> None:
        for _, y in entries(batch.column("v")):
            _add(states, y)

    moments = gathered(finite(vectors, id_col, vec_col).select("v"), read)
    return {d: Whitening.fitted(m, most) for d, m in moments.items()}


def transform(vectors: DataFrame, model: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, d, n, deviation, whitened (array), as fitted by ``fit``."""
    rows = finite(vectors, id_col, vec_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in entries(batch.column("v")):
                w = model[y.shape[1]]
                z = w.project(y)
                columns = [
                    batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(y), y.shape[1], np.int32)), pa.array(np.full(len(y), w.n, np.int64)), pa.array(w.deviations(y), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "d", "n", "deviation", "whitened"])

    return rows.mapInArrow(lean(run), f"vec_id {id_type}, d int, n long, deviation long, whitened array<double>")


def identity_errors(whitened: DataFrame, model: dict[int, Whitening]) -> dict[int, float]:
    """By length: the largest entry of the whitened rows' covariance minus the identity."""
    out = {}
    for d, w in model.items():

        def read(batch: pa.RecordBatch, states: dict[int, Moments], wide: int = len(w.spread)) -> None:
            _add(states, batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide), exact=False)

        found = gathered(whitened.where(F.col("d") == d).select("whitened"), read)
        gap = found[len(w.spread)].covariance() - np.eye(len(w.spread))
        out[d] = float(np.abs(gap[np.ix_(w.spread, w.spread)]).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, most, id_col, vec_col)
    rows = written(transform(vectors, model, id_col, vec_col), "whitened")
    errors = identity_errors(rows, model)
    known = "d int, shares array<double>, identity_error double"
    # one row for each length of vector
    facts = rows.sparkSession.createDataFrame([(d, w.explained.tolist(), errors[d]) for d, w in model.items()], known)
    rows = rows.join(F.broadcast(facts.withColumnRenamed("d", "__d")), F.col("d") == F.col("__d"))
    return rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "shares")).alias("k", "x")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.shares").alias("explained"), "identity_error"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
