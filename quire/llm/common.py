"""Shared plumbing of the corpus operators: tables, recoverable intermediate tables, links.

Nothing here keeps state on one machine: intermediate results are Parquet tables in the shared
folder named by ``spark.checkpoint.dir``, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORK_KEY = "spark.checkpoint.dir"
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """Shared scratch folder: the cluster's own setting.

    Where it is unset, a temporary folder serves a session that runs in one process; on a cluster
    no such folder is shared, so it is an error there.
    """
    folder = spark.conf.get(WORK_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {WORK_KEY} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-work-")
        spark.conf.set(WORK_KEY, folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/quire/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read again, and let finished shuffles go.

    Shuffle files stay until the driver collects the plans that made them; a collection here
    frees them between rounds instead of whenever one happens to come.
    """
    spark = None
    for df in tables:
        if (path := getattr(df, "_written_to", None)) is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    if spark is not None:
        spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches of BATCH_ROWS rows, unless the session says otherwise."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving freed memory back at the end of each task.

    Workers live on from task to task; what their allocators keep would add up to an executor's
    limit over the stages of a pipeline.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return task


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class TextBatch:
    """Zero-copy view of an Arrow string column: one byte buffer and row bounds. Null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.bytes = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
        self.view = memoryview(self.bytes)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.view[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def groups(self, limit: int = 4 << 20):
        """Row ranges of about ``limit`` bytes each, so that working memory stays bounded."""
        start = 0
        while start < len(self):
            stop = int(np.searchsorted(self.bounds, self.bounds[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), len(self))
            yield start, stop
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``links``: one row (node, component) per linked node.

    ``component`` is the smallest node that can be reached. Alternates two star contractions
    until no link changes; every step is a grouped minimum (combined before the shuffle) and an
    equi-join, so no component is ever gathered in one task or on the driver. Null ends are
    ignored. No links: no rows.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.union(down.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def drop_marked(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without marked rows. ``keys``: doc_id, raw, n rows of that key, n_kept of them.

    A row's key is its id with the hash of its raw text, so an id that names several texts is no
    trouble. Rows without a key stay. Where n_kept of n equal rows stay, one of them does.
    """
    keys = written(keys.select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), F.col("n_kept").alias("__kept")), "marks")
    rows = docs.withColumn("__own", F.xxhash64(F.col(text_col)))
    rows = rows.join(keys, rows[id_col].eqNullSafe(keys["__id"]) & (rows["__own"] == keys["__raw"]), "left")
    stay = rows.where("__kept is null").select(docs.columns)
    if keys.where("__kept > 0").isEmpty():
        return stay
    return stay.union(rows.where("__kept > 0").dropDuplicates(["__id", "__raw"]).select(docs.columns))
