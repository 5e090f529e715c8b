"""Folders as a stream: new files under roots that may be added while it runs.

The reader writes what belongs to each batch to a log before Spark hears of it, so an offset is the
number of a log entry: a batch that is run again reads the same files, and a restart from a
checkpoint loses and repeats nothing. A batch is cut by summed size and number of files; a file
above the bound comes alone. Log and roots lie in one folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from quire.sources.files import SCHEMA, file_row, listed

#: A folder whose time of change is younger may change again within the clock's grain.
GRAIN_NS = 2_000_000_000
#: Entries that are merged at a time once they are done.
MERGED = 64


def add_root(log: str, root: str) -> None:
    """From its next look on the stream sees ``root`` too."""
    _put(f"{log}/roots", hashlib.sha256(root.encode()).hexdigest()[:32], [root])


def _put(folder: str, name: str, lines: list) -> None:
    """A file of JSON lines, made in one step."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{folder}/.{name}", f"{folder}/{name}")


def _get(path: str) -> list:
    with open(path) as f:
        return [json.loads(line) for line in f]


def packed(files: list[list], task_bytes: int) -> list[list[list]]:
    """Files (root, path, size) in loads of about ``task_bytes``: largest first, each to the lightest load."""
    n = min(len(files), max(1, -(-sum(f[2] for f in files) // task_bytes)))
    loads, weights = [[] for _ in range(n)], [0] * n
    for f in sorted(files, key=lambda f: (-f[2], f[1])):
        k = weights.index(min(weights))
        loads[k].append(f)
        weights[k] += f[2] + 1
    return loads


class _Load(InputPartition):
    def __init__(self, files: list[list]):
        self.files = files


class _LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.log = options["log"].rstrip("/")
        self.roots = [r for r in options.get("path", "").split(";") if r]
        self.head = int(options.get("headbytes", "-1"))
        self.most_bytes, self.most_files = int(options.get("maxbytes", str(1 << 30))), int(options.get("maxfiles", "100000"))
        self.task_bytes = int(options.get("taskbytes", str(128 << 20)))
        self.last = -1  # the log is not read yet
        self.seen: set[bytes] = set()
        self.folders: dict[str, tuple[int, list[str]]] = {}
        self.waiting: deque[list] = deque()

    def _entries(self, kind: str) -> list[int]:
        try:
            return sorted(int(n[len(kind) + 1 :]) for n in os.listdir(self.log) if n.startswith(f"{kind}-"))
        except FileNotFoundError:
            return []

    def _key(self, path: str) -> bytes:
        return hashlib.blake2b(path.encode("utf-8", "surrogateescape"), digest_size=16).digest()

    def _load_log(self) -> None:
        self.last = 0
        for kind in ("done", "batch"):
            for n in self._entries(kind):
                self.seen |= {self._key(f[1]) for f in _get(f"{self.log}/{kind}-{n}")}
                self.last = max(self.last, n)

    def _look(self) -> None:
        """New files of all roots join those that wait; folders that did not change are not read again."""
        roots = list(dict.fromkeys(self.roots + [r for n in sorted(os.listdir(f"{self.log}/roots")) if n[0] != "." for r in _get(f"{self.log}/roots/{n}")] if os.path.isdir(f"{self.log}/roots") else self.roots))
        for root in roots:
            todo = deque([root])
            while todo:
                folder, now = todo.popleft(), time.time_ns()
                try:
                    changed = os.stat(folder).st_mtime_ns
                except OSError:
                    continue
                if folder in self.folders and self.folders[folder][0] == changed:
                    todo += self.folders[folder][1]
                    continue
                below, files = listed(folder)
                todo += below
                for e in files:
                    if (key := self._key(e.path)) not in self.seen:
                        self.seen.add(key)
                        self.waiting.append([root, *file_row(root, e.path, 0)[0:3:2]])
                if now - changed > GRAIN_NS:
                    self.folders[folder] = changed, below

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """One more entry if files wait: as many as the bounds admit, at least one."""
        if self.last < 0:
            self._load_log()
        self._look()
        batch, size = [], 0
        while self.waiting and len(batch) < self.most_files and (not batch or size + self.waiting[0][2] <= self.most_bytes):
            batch.append(self.waiting.popleft())
            size += batch[-1][2]
        if batch:
            _put(self.log, f"batch-{self.last + 1}", batch)
            self.last += 1
        return {"batch": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Load]:
        files = [f for n in range(start["batch"] + 1, end["batch"] + 1) for f in _get(f"{self.log}/batch-{n}")]
        return [_Load(load) for load in packed(files, self.task_bytes)] if files else []

    def read(self, partition: _Load) -> Iterator[tuple]:
        for root, path, _ in partition.files:
            yield file_row(root, path, self.head)

    def commit(self, end: dict) -> None:
        """Entries that no batch will ask for again are merged, MERGED at a time."""
        old = [n for n in self._entries("batch") if n < end["batch"]]
        if len(old) >= MERGED:
            _put(self.log, f"done-{old[-1]}", [f for n in old for f in _get(f"{self.log}/batch-{n}")])
            for n in old:
                os.remove(f"{self.log}/batch-{n}")


class LiveFolderSource(DataSource):
    """Options: path (roots, ';' between them), log (shared folder of the stream's own), headBytes,
    maxBytes and maxFiles of a batch, taskBytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "live_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LiveReader({k.lower(): v for k, v in self.options.items()})


def live_scan(spark: SparkSession, roots: list[str], log: str, head_bytes: int = -1, max_bytes: int = 1 << 30, max_files: int = 100_000, task_bytes: int = 128 << 20) -> DataFrame:
    """A stream of the files under ``roots`` and those that ``add_root`` adds, each path once.

    A stream of its own needs a ``log`` of its own, kept as long as its checkpoint.
    """
    spark.dataSource.register(LiveFolderSource)
    how = {"path": ";".join(roots), "log": log, "headBytes": head_bytes, "maxBytes": max_bytes, "maxFiles": max_files, "taskBytes": task_bytes}
    return spark.readStream.format("live_folder").options(**{k: str(v) for k, v in how.items()}).load()


def until_idle(query: StreamingQuery, seconds: float = 3.0, most: float | None = None) -> bool:
    """Stop ``query`` between batches once none brought rows for ``seconds``; False if ``most`` seconds pass first.

    A query that failed raises its error here.
    """
    began = quiet = time.monotonic()
    last = -1
    while query.isActive:
        if most is not None and time.monotonic() - began > most:
            return False
        p = query.lastProgress
        if p is None or query.status["isTriggerActive"] and query.status["isDataAvailable"]:
            quiet = time.monotonic()
        elif p["batchId"] != last and p["numInputRows"]:
            last, quiet = p["batchId"], time.monotonic()
        if time.monotonic() - quiet >= seconds:
            query.stop()
        time.sleep(0.1)
    if error := query.exception():
        raise error
    return True
