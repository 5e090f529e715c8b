"""Versioned Parquet snapshots and the opt-in ZIP sink.

A snapshot is written to a folder of its own and then named by a marker file, made by whoever comes
first. Markers are never changed or deleted by a writer, and the highest whole one counts: whenever
a job fails, readers keep the version before, and of two writers that began with one version the
second is told so.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class Conflict(RuntimeError):
    """Another writer published the version meant to be written."""


def _marks(spark: SparkSession, root: str) -> dict[int, str]:
    """Numbers of all markers, whole or not, with their paths."""
    fs, place = _fs(spark, root)
    if not fs.exists(place):
        return {}
    names = [str(x.getPath().getName()) for x in fs.listStatus(place)]
    return {int(n.removeprefix("DONE.")): f"{root}/{n}" for n in names if n.startswith("DONE.")}


def _said(spark: SparkSession, path: str) -> dict | None:
    """What a marker says; nothing if its writer did not finish it. An empty one names the folder v=<number>."""
    fs, place = _fs(spark, path)
    size = int(fs.getFileStatus(place).getLen())
    if not size:
        return {"data": f"v={path.rpartition('.')[2]}"}
    stream = fs.open(place)
    try:
        text = bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and contents of the last whole version, 0 if there is none."""
    for v, path in sorted(_marks(spark, root).items(), reverse=True):
        if (said := _said(spark, path)) is not None:
            return v, said
    return 0, {}


def current_version(spark: SparkSession, root: str) -> int:
    return current(spark, root)[0]


def publish(spark: SparkSession, root: str, after: int, said: dict) -> int:
    """Make the version that follows ``after``; Conflict if another writer has made one since."""
    v = max([after, *_marks(spark, root)]) + 1
    if current_version(spark, root) != after:
        raise Conflict(f"{root} has a version after {after}")
    fs, mark = _fs(spark, f"{root}/DONE.{v}")
    try:
        stream = fs.create(mark, False)  # fails where the marker stands
    except Exception as error:
        raise Conflict(f"{root} has a version {v}") from error
    stream.write(bytearray((json.dumps(said) + "\n").encode()))
    stream.close()
    return v


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of the last version, whether it is one folder or one for each bucket."""
    _, said = current(spark, root)
    places = [*said.get("buckets", {}).values(), *([said["data"]] if "data" in said else [])]
    return spark.read.schema(schema).parquet(*(f"{root}/{p}" for p in places)) if places else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, root: str) -> int:
    spark = df.sparkSession
    v = current_version(spark, root)
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{data}")
    return publish(spark, root, v, {"data": data})


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place in the folder of spark.checkpoint.dir, shared by driver and executors.

    Only a session that runs in one process may do without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{folder.rstrip('/')}/quire/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back, so that what made it never runs twice."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def migrated(events: DataFrame) -> DataFrame:
    """Status rows of old runs: a duplicate whose path lies in a temporary folder is ``duplicate_temp``."""
    temporary = F.col("source_path").like("%_TempPipeline%")
    return events.withColumn("status", F.when((F.col("status") == "duplicate") & temporary, "duplicate_temp").otherwise(F.col("status")))


def source_key(roots: list[str]) -> str:
    """Name of the state of a set of source folders, whatever their order."""
    import xxhash

    roots = sorted({r.rstrip("/") or "/" for r in roots})
    base = roots[0].rpartition("/")[2] if roots else ""
    return f"ls_{base or 'library'}_{xxhash.xxh64('|'.join(roots).encode()).hexdigest()[:6]}"


def pack(rows: DataFrame, level: int = 6) -> DataFrame:
    """Write each (dest, member, content) as a ZIP of one member; returns dest, status, sha256.

    Written beside its place, tested, then moved in one step; a file that stands stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dest, member, content in zip(batch["dest"], batch["member"], batch["content"], strict=True):
                temp = f"{os.path.dirname(dest)}/.__tmp_{os.path.basename(dest)}"
                try:
                    os.makedirs(os.path.dirname(dest), exist_ok=True)
                    buffer = io.BytesIO()
                    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as box:
                        box.writestr(zipfile.ZipInfo(member), bytes(content), zipfile.ZIP_DEFLATED)
                    with zipfile.ZipFile(buffer) as box:
                        ok = box.testzip() is None and box.read(member) == bytes(content)
                    if ok and os.path.exists(dest):
                        out.append((dest, "exists", None))
                        continue
                    with open(temp, "wb") as f:
                        f.write(buffer.getvalue())
                    os.replace(temp, dest)
                    out.append((dest, "packed" if ok else "pack_failed", hashlib.sha256(bytes(content)).hexdigest()))
                except OSError as error:
                    out.append((dest, f"pack_failed:{type(error).__name__}", None))
            yield pd.DataFrame(out, columns=["dest", "status", "sha256"])

    return rows.select("dest", "member", "content").mapInPandas(run, "dest string, status string, sha256 string")


def verified(packed: DataFrame, sources: DataFrame, target_root: str) -> DataFrame:
    """Adds delete_eligible: the packed content is the source's and lies under the target."""
    same = packed.join(sources.select("dest", F.sha2("content", 256).alias("__sha")), "dest", "left")
    return same.withColumn("delete_eligible", F.coalesce((F.col("status") == "packed") & (F.col("sha256") == F.col("__sha")) & T.is_under(F.col("dest"), F.lit(target_root)), F.lit(False))).drop("__sha")
