"""Folder walker as a Spark data source.

Unlike Spark's binary reader it sees names that start with '_' or '.', does not follow links, and
turns a file that cannot be read into a row of size 0 instead of failing the scan.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources.state import settled

SCHEMA = "path string, source_root string, size_bytes bigint, mtime_ns bigint, content binary"


def file_row(root: str, path: str, head: int) -> tuple:
    """A row of SCHEMA; a file that cannot be read has size 0. ``head``: bytes to read, 0 none, -1 all."""
    try:
        stat = os.stat(path, follow_symlinks=False)
        content = None
        if head:
            with open(path, "rb") as f:
                content = f.read(head) if head > 0 else f.read()
        return path, root, stat.st_size, stat.st_mtime_ns, content
    except OSError:
        return path, root, 0, 0, None


def listed(folder: str) -> tuple[list[str], list[os.DirEntry]]:
    """Folders and files right in ``folder``, by name; links are not followed, errors give nothing."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [], []
    return [e.path for e in entries if e.is_dir(follow_symlinks=False)], [e for e in entries if e.is_file(follow_symlinks=False)]


class _Folder(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [r for r in options.get("path", options.get("roots", "")).split(";") if r]
        self.head = int(options.get("headbytes", "-1"))

    def partitions(self) -> list[_Folder]:
        """A root's own files, and one partition for each folder right below it."""
        out = []
        for root in self.roots:
            out.append(_Folder(root, root, False))
            try:
                out += [_Folder(root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            folders, found = listed(todo.pop())
            todo += folders if partition.deep else []
            for e in found:
                yield file_row(partition.root, e.path, self.head)


class FolderSource(DataSource):
    """Options: path (roots, ';' between them), headBytes (0: no content, -1: all)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, roots: list[str], head_bytes: int = -1) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("path", ";".join(dict.fromkeys(roots))).option("headBytes", str(head_bytes)).load()


LISTED = "path string, source_root string, size_bytes bigint, mtime_ns bigint"


def listing(spark: SparkSession, roots: list[str], rounds: int = 64, tasks: int | None = None) -> DataFrame:
    """(path, source_root, size_bytes, mtime_ns) of all files, listed breadth-first.

    Each round lists one level of folders, dealt out over all tasks, so a tree that hangs on one top
    folder is walked as broadly as any other. After ``rounds`` levels a task walks what lies below.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "source_root string, path string")
    found = None
    for k in range(rounds):
        deep = k == rounds - 1

        def one(batches: Iterator[pa.RecordBatch], deep: bool = deep) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for root, top in zip(batch.column("source_root").to_pylist(), batch.column("path").to_pylist(), strict=True):
                    todo = [top]
                    while todo:
                        folders, inside = listed(todo.pop())
                        todo += folders if deep else []
                        rows = [] if deep else [(p, root, None, None) for p in folders]
                        rows += [file_row(root, e.path, 0)[:4] for e in inside]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "source_root", "size_bytes", "mtime_ns"])

        rows = settled(level.repartition(tasks, "path").mapInArrow(one, LISTED), "listing")
        found = rows if found is None else found.unionByName(rows)
        level = rows.where("size_bytes is null").select("source_root", "path")
        if level.isEmpty():
            break
    return found.where("size_bytes is not null")


def balanced_scan(spark: SparkSession, roots: list[str], head_bytes: int = -1, task_bytes: int = 128 << 20, tasks: int | None = None) -> DataFrame:
    """The rows of ``scan``, read by tasks of about ``task_bytes`` each, a larger file by one of its own.

    Files are packed where they were listed, by a running sum, and only their names are dealt out.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            loads = []
            for size in batch.column("size_bytes").to_pylist():
                if held and held + size > task_bytes:
                    load, held = load + 1, 0
                held += size
                loads.append(load)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("source_root"), pa.array(loads, pa.int64())], names=["path", "source_root", "load"])

    loads = settled(listing(spark, roots, tasks=tasks).select("path", "source_root", "size_bytes").mapInArrow(packed, "path string, source_root string, load bigint"), "loads")
    # each load is numbered by its rank, so that none shares a task with another
    numbers = loads.select("load").distinct().orderBy("load").select("load", F.row_number().over(Window.orderBy("load")).alias("n"))
    numbers = settled(numbers, "load-numbers")
    n = max(1, numbers.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for root, path in zip(batch.column("source_root").to_pylist(), batch.column("path").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(file_row(root, path, head_bytes), kinds, strict=True)], names=["path", "source_root", "size_bytes", "mtime_ns", "content"])

    dealt = loads.join(numbers, "load").repartitionById(n, (F.col("n") - 1).cast("int"))
    return dealt.select("path", "source_root").mapInArrow(read, SCHEMA)


def target_zips(files: DataFrame, excluded: list[str]) -> DataFrame:
    """ZIP files of a target folder, without unfinished ones and excluded folders."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = files.where(F.lower(name).endswith(".zip") & ~name.startswith(".__tmp_"))
    for folder in excluded:
        out = out.where(~F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    return out


def log_routes(spark: SparkSession, path: str) -> DataFrame:
    """genre, letter, author, title of the routing lines of a log."""
    parts = F.split(F.regexp_extract("value", r"dest=(.+)", 1), r"[\\/]")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    rows = spark.read.text(path).where(F.contains("value", F.lit("A7 route")) & F.col("value").rlike("dest=.+")).where(F.size(parts) >= 4)
    return rows.select(at(-4).alias("genre"), at(-3).alias("letter"), at(-2).alias("author"), F.regexp_replace(F.trim(at(-1)), r"\.zip$", "").alias("title"))
