"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

1. Equal vectors become one class with a multiplicity.
2. Each class vector is turned by pseudo-random rotations (three rounds of sign flips and a fast
   Hadamard transform). The axis nearest to the turned vector, with its sign, is a hash; ``k`` of
   them name a bucket, and a vector also enters its next-best buckets. ``k`` follows the number of
   vectors, so buckets stay small; tables are added until a pair at the threshold is missed with
   probability ``miss`` at most.
3. Buckets above ``block`` vectors are cut into blocks that meet pairwise, so no task gathers a
   whole bucket. A pair is verified by its cosine in double precision where it first meets; what
   leaves a task are link counts and a spanning forest of the links, never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link, each length is searched by itself; a repeated id is
one node of the link graph, its rows are counted singly; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import components, lean, table, written

MANY = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast orthonormal Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    span = 1
    while span < d:
        v = x.reshape(n, d // (2 * span), 2, span)
        x = np.concatenate((v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]), axis=2).reshape(n, d)
        span *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hash tables of ``k`` joined cross-polytope hashes with ``probes`` buckets each."""

    def __init__(self, dim: int, k: int, tables: int, probes: int, seed: int = 11):
        self.dim, self.k, self.tables, self.probes = dim, k, tables, probes
        self.width = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, k, 3, self.width))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) bucket codes; the first probe is the vector's own bucket."""
        n = len(unit)
        base = np.zeros((n, self.width))
        base[:, : self.dim] = unit
        out = np.empty((n, self.tables, self.probes), np.int64)
        rows = np.arange(n)
        for t in range(self.tables):
            firsts, others, losses = [], [], []
            for j in range(self.k):
                y = base
                for s in self.signs[t, j]:
                    y = hadamard(y * s)
                size = np.abs(y)
                first = size.argmax(axis=1)
                top = size[rows, first]
                size[rows, first] = -1.0
                second = size.argmax(axis=1)
                firsts.append(first * 2 + (y[rows, first] < 0))
                others.append(second * 2 + (y[rows, second] < 0))
                losses.append(top - size[rows, second])
            # ways to swap some hashes for their runner-up, least total loss first
            ways = [()] + [w for r in range(1, self.k + 1) for w in combinations(range(self.k), r)]
            loss = np.stack([sum((losses[j] for j in w), np.zeros(n)) for w in ways], axis=1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
            made = np.empty((n, len(ways)), np.int64)
            for w, way in enumerate(ways):
                code = np.zeros(n, np.int64)
                for j in range(self.k):
                    code = code * (2 * self.width) + (others[j] if j in way else firsts[j])
                made[:, w] = code
            picked = np.take_along_axis(made, best, axis=1)
            out[:, t] = np.pad(picked, ((0, 0), (0, self.probes - picked.shape[1])), mode="edge")
        return out


def choose(n: int, dim: int, cosine: float, miss: float, probes: int = 3, trials: int = 2000) -> CrossPolytope:
    """Hash lengths for ``n`` vectors and as many tables as the allowed miss at ``cosine`` asks for.

    Hashes are shortened until ``MANY`` tables are enough; single ones get all tables they need.
    """
    width = 1 << max(0, dim - 1).bit_length()
    k = max(1, int(np.log(max(n, 2)) / np.log(2 * max(2, width))))
    rng = np.random.default_rng(5)
    a = rng.normal(size=(trials, dim))
    b = rng.normal(size=(trials, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    while True:
        one = CrossPolytope(dim, k, 1, probes)
        meet = (one.codes(a)[:, 0, :, None] == one.codes(b)[:, 0, None, :]).any(axis=(1, 2)).mean()
        tables = np.ceil(np.log(miss) / np.log1p(-min(meet, 0.999))) if meet > 0 else np.inf
        if tables <= MANY or k == 1:
            break
        k -= 1
    if tables == np.inf:
        raise ValueError(f"pairs at cosine {cosine} meet in no bucket")
    return CrossPolytope(dim, k, max(2, int(tables)), probes)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes reaches over the links i - j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _first_meeting(codes: np.ndarray, table_no: np.ndarray, code: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether (table, code) is the first bucket that the rows i and j share."""
    ok = np.ones(len(i), bool)
    for k in range(0, len(i), 200_000):
        s = slice(k, k + 200_000)
        same = codes[i[s]][:, :, :, None] == codes[j[s]][:, :, None, :]
        met = same.any(axis=(2, 3))
        first = met.argmax(axis=1)
        shared = np.where(same[np.arange(len(first)), first].any(axis=2), codes[i[s], first], np.iinfo(np.int64).max).min(axis=1)
        ok[s] = (first == table_no[i[s]]) & (shared == code[i[s]])
    return ok


def _groups_linked(g: dict[str, np.ndarray], starts: np.ndarray, cosine: float):
    """Links (i, j) inside each group of rows that meet; rows are sorted by group."""
    stops = np.append(starts[1:], len(g["rep"]))
    sizes = stops - starts
    unit = g["unit"]
    found = []
    small = sizes <= 32
    lag_ok = np.repeat(np.where(small, stops, 0), sizes)
    for lag in range(1, int(sizes[small].max(initial=0))):
        i = np.flatnonzero(np.arange(len(unit)) + lag < lag_ok)
        for s in range(0, len(i), 100_000):
            part = i[s : s + 100_000]
            hit = part[np.einsum("ij,ij->i", unit[part], unit[part + lag]) >= cosine]
            found.append((hit, hit + lag))
    for a, b in zip(starts[~small].tolist(), stops[~small].tolist(), strict=True):
        for s in range(a, b, 512):
            i, j = np.nonzero(unit[s : min(s + 512, b)] @ unit[s:b].T >= cosine)
            keep = i < j
            found.append((i[keep] + s, j[keep] + s))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def link_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 0.005, block: int = 512, id_col: str = "vec_id", vec_col: str = "embedding", hashing: CrossPolytope | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
    bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("bad", F.coalesce(bad, F.lit(True))).withColumn("d1", F.when(~F.col("bad"), F.xxhash64("v", F.lit(1)))).withColumn("d2", F.when(~F.col("bad"), F.xxhash64("v", F.lit(2))))
    classes = rows.where("not bad").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = written(classes, "vec-classes")
    # lengths that only one class has hold no pair
    dims = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()
    same = classes.select("d1", "d2", "rep", "m")
    if not dims:
        counts, comps = same.select("d1", "d2", F.lit(0).cast("long").alias("links")), same.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    else:
        fits = lambda d: hashing is not None and hashing.dim == d
        found = reduce(DataFrame.union, [_linked(classes.where(F.size("v") == x["d"]), hashing if fits(x["d"]) else choose(x["n"], x["d"], cosine, miss), cosine, block) for x in dims])
        counts, comps = found.groupBy("d1", "d2").agg(F.sum("links").alias("links")), components(found.select("a", "b"))
    same = same.join(counts, ["d1", "d2"], "left").join(comps, F.col("rep") == F.col("node"), "left")
    same = written(same.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vec-links")
    out = rows.drop("v").join(same, ["d1", "d2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _linked(classes: DataFrame, hashing: CrossPolytope, cosine: float, block: int) -> DataFrame:
    """(d1, d2, links, a, b): link counts and a spanning forest of classes of one length."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(hashing)
    n_codes = hashing.tables * hashing.probes

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsh = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, lsh.dim)
                top = np.abs(v).max(axis=1, keepdims=True)
                v = v / top
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                codes = lsh.codes(unit)
                flat = pa.array(codes.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("d1", "d2", "rep", "m")), pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * lsh.dim), len(unit), [None, pa.py_buffer(np.ascontiguousarray(unit).tobytes())]).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * n_codes, pa.int32()), flat)],
                    names=["d1", "d2", "rep", "m", "unit", "codes"],
                )

    hashes = classes.select("d1", "d2", "rep", "m", "v").mapInArrow(lean(hashed), "d1 long, d2 long, rep long, m long, unit binary, codes array<long>")
    hashes = written(hashes, "vec-codes")
    at = F.posexplode("codes").alias("p", "code")
    placed = hashes.select("d1", "d2", "rep", "m", "unit", "codes", at).withColumn("t", F.floor(F.col("p") / hashing.probes).cast("int")).drop("p")
    sizes = hashes.select(at).groupBy(F.floor(F.col("p") / hashing.probes).cast("int").alias("t"), "code").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(sizes, ["t", "code"])
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod("d2", parts).cast("int")
    # block i meets the blocks j of its bucket: cells (min, max)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("t", "code", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "d1", "d2", "rep", "m", "unit", "codes")
    met = placed.repartition("t", "code", "bi", "bj").sortWithinPartitions("t", "code", "bi", "bj", "d1", "d2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsh, held = shared.value, None
        keys = ("t", "code", "bi", "bj")

        def work(rows: pa.Table) -> pa.RecordBatch | None:
            g = {c: rows.column(c).to_numpy() for c in (*keys, "own", "d1", "d2", "rep", "m")}
            new = np.ones(rows.num_rows, bool)
            new[1:] = False
            for c in keys:
                new[1:] |= g[c][1:] != g[c][:-1]
            # a vector that probes one bucket twice stands there once
            twin = np.zeros(rows.num_rows, bool)
            twin[1:] = ~new[1:] & (g["d1"][1:] == g["d1"][:-1]) & (g["d2"][1:] == g["d2"][:-1])
            pick = np.flatnonzero(~twin)
            g = {c: v[pick] for c, v in g.items()}
            new = new[pick]
            part = rows.take(pa.array(pick)).combine_chunks()
            if not part.num_rows:
                return None
            g["unit"] = np.frombuffer(b"".join(part.column("unit").to_pylist()), float).reshape(-1, lsh.dim)
            codes = part.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, lsh.tables, lsh.probes)
            i, j = _groups_linked(g, np.flatnonzero(new), cosine)
            # in a cell of two blocks only pairs across them are its own
            across = (g["bi"][i] == g["bj"][i]) | (g["own"][i] != g["own"][j])
            i, j = i[across], j[across]
            ok = _first_meeting(codes, g["t"], g["code"], i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                return None
            links = np.bincount(i, g["m"][j], len(new)) + np.bincount(j, g["m"][i], len(new))
            root = _forest(len(new), i, j)
            told = np.flatnonzero(links > 0)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (g["d1"][told], g["d2"][told], links[told].astype(np.int64), g["rep"][told], g["rep"][root[told]])], names=["d1", "d2", "links", "a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [rows.column(c)[-1].as_py() for c in keys]
            differs = np.zeros(rows.num_rows, bool)
            for c, v in zip(keys, last, strict=True):
                differs |= rows.column(c).to_numpy() != v
            whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            held = rows.slice(whole)
            if whole and (out := work(rows.slice(0, whole))) is not None:
                yield out
        if held is not None and (out := work(held)) is not None:
            yield out

    return written(met.mapInArrow(lean(compare), "d1 long, d2 long, links long, a long, b long"), "vec-found")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
