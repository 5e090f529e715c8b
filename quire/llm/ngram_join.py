"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters.

1. Shingles are counted over all documents in a table of hashed counters of fixed size. A shingle's
   place in the global order is its counter, then its hash, so rare shingles come first.
2. Documents with one set of shingles become one class. A class keeps the prefix of its ordered
   set that any partner at the threshold must meet, its size, and a parity sketch of the set.
3. Classes join on prefix shingles. Length and position bounds are part of the join; the suffix
   filter bounds the Hamming distance of the sets from below by that of their sketches.
4. Pairs that are left are verified on whole sets, once per pair. Only texts of the classes in
   question are read again, found through a bitmap of fixed size; a wider sketch spares most
   pairs that fail the move of their texts.

A shingle that only one class has meets nothing: bitmaps of fixed size tell most of those where
classes are read, so they do not travel.

A shingle shared by more than ``star`` classes does not emit all pairs: its classes are first
compared with one leader, then (in further rounds, with several leaders, drawn from classes without
links as long as there are any) only with classes that are not yet in the same component, at last
all such pairs. A skipped pair is one whose ends are connected already, so components are exact and
nothing is capped. The last round has each pair at the first of its crowded shingles, as far as both
classes name it among their first ``FIRSTS``.

Defined results: null text and text without words have no shingles, n_shingles 0, and link with
nothing; fewer words than a shingle count as one shingle; equal sets link; rows that repeat an id
are rows of their own; a component whose ids are all null has a null id; an empty table gives no
rows; other columns are ignored by ``link_texts`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quire.llm.common import TextBatch, components, discard, drop_marked, lean, mix64, small_batches, table, written

COUNTER_BITS, SLICE_BITS = 20, 14
NODE_BITS = 26
LANES, WIDE = 16, 64
LEADERS, FIRSTS = 4, 6
SKETCH = [f"s{k}" for k in range(LANES)]
_ODD = np.array([0x9E6C63D0876A9A99, 0xC2B2AE3D27D4EB4F, 0xB492B66FBE98F273, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xA0761D6478BD642F], np.uint64)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text, with a bounded cache of word hashes."""

    def __init__(self, width: int):
        self.width = width

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > 250_000:
                    self.clear()
                self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                return out

        self.words = Words()

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z and the six white-space characters only
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if n < self.width:
            total = np.array([n], np.uint64) * _ODD[-1]
            for k in range(n):
                total = total + ids[k : k + 1] * (_ODD[k % len(_ODD) : k % len(_ODD) + 1] * np.uint64(2 * k + 3))
            return mix64(total)
        total = ids[: n - self.width + 1] * _ODD[0]
        for k in range(1, self.width):
            total += ids[k : n - self.width + 1 + k] * _ODD[k % len(_ODD)]
        return np.unique(mix64(total))


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketch(shingles: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Parity bits: each differing shingle flips one, so distance never exceeds the sets'."""
    bits = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (64 * lanes - 1), minlength=64 * lanes) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))


def _planes(counts: np.ndarray) -> bytes:
    """32-bit counters, all lowest bytes first: the others are mostly zero and compress away."""
    return counts.view(np.uint8).reshape(-1, 4).T.tobytes()


def shingle_counters(source: DataFrame, width: int) -> np.ndarray:
    """Documents by hashed shingle. Summed in Spark by slice; 2**COUNTER_BITS numbers come back."""
    slices, span = 1 << (COUNTER_BITS - SLICE_BITS), 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, counts = Shingler(width), np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            texts = TextBatch(batch.column("text"))
            for a, b in texts.groups(1 << 20):
                found = [make.of(texts.text(i)) for i in range(a, b)]
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([_planes(x) for x in counts.reshape(slices, span)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint8).reshape(4, span).T.copy().view(np.uint32).ravel().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    parts = source.select("text").mapInArrow(lean(count), "slice int, counts binary").repartition(slices, "slice").mapInArrow(add, "slice int, counts binary")
    out = np.zeros((slices, span), np.uint64)
    for row in parts.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
    return out.ravel()


def prefixes(source: DataFrame, counters: np.ndarray, width: int, percent: int) -> DataFrame:
    """Per document: doc_id, raw, d (digest of the set), n, sketch columns, prefix (rare first)."""
    shared = source.sparkSession.sparkContext.broadcast(counters)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, counts = Shingler(width), shared.value
        for batch in batches:
            texts = TextBatch(batch.column("text"))
            for a, b in texts.groups(1 << 20):
                d, n, s, p = [], [], np.zeros((b - a, LANES), np.int64), []
                for i in range(a, b):
                    x = make.of(texts.text(i))
                    d.append(digest(x))
                    n.append(len(x))
                    if len(x):
                        s[i - a] = sketch(x)
                        often = counts[(x >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                        p.append(x[np.argsort(often, kind="stable")[: prefix_size(len(x), percent)]].view(np.int64))
                    else:
                        p.append(np.zeros(0, np.int64))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in p]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("raw").slice(a, b - a), pa.array(d, pa.binary()), pa.array(n, pa.int32()), *(pa.array(s[:, k]) for k in range(LANES)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(p)))],
                    names=["doc_id", "raw", "d", "n", *SKETCH, "prefix"],
                )

    return source.mapInArrow(lean(run), f"doc_id {id_type}, raw long, d binary, n int, {', '.join(f'{c} long' for c in SKETCH)}, prefix array<long>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """2**NODE_BITS bits, a fixed size whatever the input; those of column ``x`` are set."""
    places = hashes.select((F.pmod("x", F.lit(1 << NODE_BITS)) + 1).alias("x"))
    marks = places.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << NODE_BITS) // 8, np.uint8)
    for row in marks.collect():
        start = (row["bucket"] - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _marked(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    place = x & np.int64((1 << NODE_BITS) - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _thinned(classes: DataFrame, often: DataFrame, star: int) -> DataFrame:
    """``classes`` with ``pos`` and ``h`` of those prefix shingles that other classes may share.

    None that is shared is left out. ``firsts``: the first few of them that may be crowded.
    """
    marks = [_bitmap(often.where(F.col("c") > least).select(F.col("h").alias("x"))) for least in (1, star)]
    shared = classes.sparkSession.sparkContext.broadcast(marks)
    rest = [f for f in classes.schema if f.name != "prefix"]
    schema = StructType([*rest, StructField("pos", ArrayType(IntegerType())), StructField("h", ArrayType(LongType())), StructField("firsts", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, many = shared.value
        for batch in batches:
            lists = batch.column("prefix")
            h, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            row, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends = lambda keep: pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(sizes))))), pa.int32())
            keep = _marked(some, h)
            first = np.flatnonzero(_marked(many, h))
            counts = np.bincount(row[first], minlength=len(sizes))
            first = first[np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts) < FIRSTS]
            told = [pa.ListArray.from_arrays(ends(keep), pa.array(pos[keep], pa.int32())), pa.ListArray.from_arrays(ends(keep), pa.array(h[keep])), pa.ListArray.from_arrays(ends(first), pa.array(h[first]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *told], names=schema.names)

    return classes.mapInArrow(lean(run), schema)


def _texts(source: DataFrame, pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(d, n, wide, body) of the classes in ``pairs``; others may come along, none is left out.

    ``wide`` is a sketch of 64 * WIDE bits, ``body`` the text whose shingles the class has.

    A class with copies in several tasks comes once from each.

    ``texts`` names one text of each class by its hash. Texts outside a bitmap of those hashes are
    passed over before anything is made of them.
    """
    nodes = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct()
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(nodes.join(texts, "d").select(F.col("raw").alias("x"))))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(width), set()
        for batch in batches:
            batch = batch.filter(pa.array(_marked(shared.value, batch.column("raw").to_numpy())))
            texts = TextBatch(batch.column("text"))
            for a, b in texts.groups(1 << 20):
                d, n, wide, bodies = [], [], [], []
                for i in range(a, b):
                    body = texts.text(i)
                    x = make.of(body)
                    name = digest(x)
                    if name is not None and name not in seen:
                        seen.add(name)
                        d.append(name)
                        n.append(len(x))
                        wide.append(sketch(x, WIDE).tolist())
                        bodies.append(body)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(n, pa.int32()), pa.array(wide, pa.list_(pa.int64())), pa.array(bodies, pa.binary())], names=["d", "n", "wide", "body"])

    return source.select("raw", "text").mapInArrow(lean(digests), "d binary, n int, wide array<long>, body binary")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that reach the similarity.

    A wide sketch of each end settles most of the pairs that do not; whole texts travel only for
    the others, and their sets are compared as they are.
    """
    brief = texts.select("d", "n", "wide").dropDuplicates(["d"])
    ends = pairs.join(brief.toDF("a", "na", "wa"), "a").join(brief.toDF("b", "nb", "wb"), "b")
    distance = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = written(ends.where((100 + percent) * distance <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b"), "join-near")
    bodies = texts.groupBy("d").agg(F.first("body").alias("body"))
    both = near.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(width)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = make.of(x.as_py()), make.of(y.as_py())
                keep.append((100 + percent) * len(np.intersect1d(p, q, assume_unique=True)) >= percent * (len(p) + len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with _batches_of(pairs.sparkSession, 64):
        return written(both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a binary, b binary").distinct(), "join-verified")


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of few rows while long texts travel in pairs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _could_link(percent: int) -> Column:
    """Length and positional bounds for rows l, r that share a prefix shingle."""
    na, nb, pa_, pb = F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos")
    long_enough = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return long_enough & ((100 + percent) * most >= percent * (na + nb))


def _near_sketch(percent: int) -> Column:
    """Suffix filter: a linked pair differs in (100 - t) / (100 + t) of n_l + n_r at most."""
    distance = sum((F.bit_count(F.col(f"l.s{k}").bitwiseXOR(F.col(f"r.s{k}"))) for k in range(LANES)), F.lit(0))
    return (100 + percent) * distance <= (100 - percent) * (F.col("l.n") + F.col("r.n"))


def _pairs(joined: DataFrame) -> DataFrame:
    a, b = F.col("l.d"), F.col("r.d")
    return joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def link_texts(docs: DataFrame, width: int = 3, percent: int = 90, star: int = 4, star_rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, raw, n_shingles, component_id, grp (names the component)."""
    small_batches(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    whole = written(prefixes(source, shingle_counters(source, width), width, percent), "join-prefixes")
    rows = written(whole.select("doc_id", "raw", "d", "n"), "join-rows")
    classes = whole.where("d is not null").groupBy("d").agg(F.min("doc_id").alias("least_id"), F.min("raw").alias("raw"), *(F.first(c).alias(c) for c in ("n", *SKETCH, "prefix")))
    classes = written(classes, "join-classes")
    discard(whole)
    often = written(classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "join-often")
    thin = written(_thinned(classes, often, star), "join-thin")
    discard(classes)
    entries = thin.select("d", "n", F.inline(F.arrays_zip("pos", "h")))
    shared = written(entries.join(often, "h"), "join-entries")
    discard(often)
    classes = thin.drop("pos", "h")
    slim = classes.select("d", "n", *SKETCH)
    crowded = written(shared.where(F.col("c") > star).drop("c").join(classes.select("d", *SKETCH, "firsts"), "d"), "join-crowded")

    few = shared.where(F.col("c") <= star)
    near = _pairs(few.alias("l").join(few.alias("r"), (F.col("l.h") == F.col("r.h")) & (F.col("l.d") < F.col("r.d")) & _could_link(percent)))
    near = written(near, "join-few")  # so that Spark knows its size before sketches move for it
    near = near.join(slim.alias("l"), F.col("a") == F.col("l.d")).join(slim.alias("r"), F.col("b") == F.col("r.d")).where(_near_sketch(percent)).select("a", "b")

    found, tested, labels = None, None, None
    for turn in range(star_rounds + 2):
        last = turn == star_rounds + 1
        if labels is None:
            crowd = crowded.withColumn("lab", F.col("d")).withColumn("alone", F.lit(True))
        else:
            crowd = crowded.join(labels, F.col("d") == F.col("node"), "left").withColumn("lab", F.coalesce("component", "d")).withColumn("alone", F.col("node").isNull()).drop("node", "component")
        crowd = crowd if labels is None else written(crowd, "join-crowd")
        left, right = crowd.alias("l"), crowd
        if last:
            # a shingle whose classes are all connected has no pair left
            open_h = crowd.groupBy("h").agg(F.min("lab").alias("x"), F.max("lab").alias("y")).where("x <> y").select("h")
            right = written(crowd.join(written(open_h, "join-open"), "h", "left_semi"), "join-rest")
            # what both have among their firsts was met there, or as a pair of few classes
            first = F.get(F.array_intersect("l.firsts", "r.firsts"), F.lit(0))
            left, order, once = right.alias("l"), F.col("l.d") < F.col("r.d"), first.isNull() | (first == F.col("l.h"))
        else:
            place = F.xxhash64(F.lit(turn), "d")
            several = F.pmod(place, F.lit(LEADERS)) if turn else F.lit(0)
            lead = crowd.groupBy("h", several.alias("seat")).agg(F.min(F.struct((~F.col("alone")).alias("linked"), place.alias("o"), "d", "lab", "n", "pos")).alias("x"))
            # written, so that leaders are combined before their shuffle and Spark can split the join
            lead = written(lead.select("h", "x.*"), "join-leaders")
            right, order, once = written(lead.join(slim.drop("n"), "d"), "join-sketched"), F.lit(True), F.lit(True)
        meets = (F.col("l.h") == F.col("r.h")) & (F.col("l.lab") != F.col("r.lab")) & order & _could_link(percent) & _near_sketch(percent) & once
        more = _pairs(left.join(right.alias("r"), meets))
        if turn == 0:
            more = more.union(near).distinct()
        if tested is not None:
            more = more.join(tested, ["a", "b"], "left_anti")
        more = written(more, "join-pairs")
        if more.isEmpty():
            continue
        texts = written(_texts(source, more, classes.select("d", "raw"), width), "join-texts")
        both = _verified(more, texts, width, percent)
        found = both if found is None else written(found.union(both), "join-links")
        tested = more if tested is None else tested.union(more)
        discard(texts, crowd if labels is not None else None, shared if turn == 0 else None)
        labels = written(components(found), "join-labels")

    if labels is None:
        by_class = classes.select("d", "d", F.col("least_id").alias("component_id")).toDF("d", "grp", "component_id")
    else:
        named = classes.select("d", "least_id").join(labels, F.col("d") == F.col("node"), "left").select("d", "least_id", F.coalesce("component", "d").alias("grp"))
        named = written(named, "join-named")
        by_class = named.join(named.groupBy("grp").agg(F.min("least_id").alias("component_id")), "grp").select("d", "grp", "component_id")
    out = rows.select("doc_id", "raw", F.col("n").cast("long").alias("n_shingles"), "d").join(by_class, "d", "left")
    return out.select("doc_id", "raw", "n_shingles", F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "grp")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs``, all columns, with one row (of least id) for each component."""
    rows = written(link_texts(docs, width, percent, id_col=id_col, text_col=text_col, **how).where("grp is not null"), "join-out")
    keys = rows.groupBy("grp", "doc_id", "raw").agg(F.count("*").alias("n"))
    first = keys.groupBy("grp").agg(F.sum("n").alias("all"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "raw")).alias("first")).where("`all` > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw") == F.col("first.raw"))
    marks = keys.join(first, "grp").withColumn("n_kept", stays.cast("int")).where("n_kept < n")
    return drop_marked(docs, marks.select("doc_id", "raw", "n", "n_kept"), id_col, text_col)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_texts(table(spark, sf_dir, "documents")).drop("raw", "grp")
