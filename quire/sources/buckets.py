"""Keyed tables as Parquet buckets: an upsert rewrites only the buckets that its keys fall in.

A row lies in the bucket of its key's hash. A version's marker points at a folder for each bucket; an
upsert reads the buckets of changed keys, writes their successors to new folders and publishes a
marker in which the other buckets stay what they were. If another writer was first, it begins anew
from that one's version. The status log on top takes events as parts and merges them now and then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import dedupe
from quire.sources.state import Conflict, _fs, current, publish, settled


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def read(spark: SparkSession, root: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """All rows, or those of some buckets."""
    _, said = current(spark, root)
    return _rows(spark, root, schema, said, only)


def _rows(spark: SparkSession, root: str, schema: str, said: dict, only: list[int] | None) -> DataFrame:
    places = [f"{root}/{p}" for k, p in said.get("buckets", {}).items() if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def matching(spark: SparkSession, root: str, schema: str, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of the keys in ``wanted``, from their buckets alone."""
    _, said = current(spark, root)
    if not said:
        return spark.createDataFrame([], schema)
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    # numbers of buckets: at most as many as there are
    touched = [r[0] for r in keys.select(_bucket(F.col(key), said["n"])).distinct().collect()]
    return _rows(spark, root, schema, said, touched).join(keys, key, "left_semi")


def upsert(spark: SparkSession, root: str, schema: str, key: str, new: DataFrame, removed: DataFrame | None = None, n: int = 64, tries: int = 5, more: dict | None = None) -> list[int]:
    """Put in ``new`` by key, take out the keys of ``removed``; the numbers of the buckets rewritten.

    ``n`` buckets are made by the first upsert and stay; ``new`` has one row for each key (another one
    makes it an error). A row that is in both is put in. Null keys are an error too: they name no row.
    """
    new = settled(new.select(*spark.createDataFrame([], schema).columns), "upsert")
    if new.where(F.col(key).isNull()).limit(1).count() or new.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} must name each new row once")
    gone = None if removed is None else settled(removed.select(key).where(F.col(key).isNotNull()).distinct(), "removed")
    for _ in range(tries):
        version, said = current(spark, root)
        size = said.get("n", n)
        changed = new.select(key) if gone is None else new.select(key).unionByName(gone)
        touched = sorted(r[0] for r in changed.select(_bucket(F.col(key), size)).distinct().collect())
        old = _rows(spark, root, schema, said, touched)
        kept = old.join(changed.distinct(), key, "left_anti").select(new.columns)
        folder = f"data-{uuid.uuid4().hex}"
        rows = kept.unionByName(new).withColumn("__bucket", _bucket(F.col(key), size))
        if touched:
            rows.repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(f"{root}/{folder}")
        buckets = {k: p for k, p in said.get("buckets", {}).items() if int(k) not in touched}
        fs, _place = _fs(spark, root)
        for k in touched:
            place = f"{folder}/__bucket={k}"
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{place}")):
                buckets[str(k)] = place
        try:
            publish(spark, root, version, {**said, **(more or {}), "n": size, "buckets": buckets})
            return touched
        except Conflict:
            continue
    raise Conflict(f"{root} changed {tries} times while it was written")


def append_events(events: DataFrame, path: str) -> None:
    """One more part of a status log; readers see it at once, whole."""
    events.write.parquet(f"{path}/parts/{uuid.uuid4().hex}")


def _parts(spark: SparkSession, path: str) -> list[str]:
    fs, place = _fs(spark, f"{path}/parts")
    if not fs.exists(place):
        return []
    whole = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{name}/_SUCCESS"))
    return sorted(n for n in (str(x.getPath().getName()) for x in fs.listStatus(place)) if whole(n))


def latest_status(spark: SparkSession, path: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: the merged base and the parts that came since."""
    _, said = current(spark, path)
    base = _rows(spark, path, schema, said, None)
    since = [f"{path}/parts/{p}" for p in _parts(spark, path) if p not in said.get("merged", [])]
    rows = base.unionByName(spark.read.schema(schema).parquet(*since)) if since else base
    return _last(rows, key, order)


def _last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    columns = [c for c in rows.columns if c != key]
    return dedupe.latest(rows, key, order, columns).select(rows.columns)


def compact(spark: SparkSession, path: str, schema: str, key: str, order: list[str], n: int = 64) -> list[int]:
    """Merge the parts into the base while readers go on; the numbers of the buckets rewritten.

    A part that was merged is named by the version that holds it, so no reader counts it twice, and
    deleted by the next merge: whoever began to read with the version before still finds it.
    """
    _, said = current(spark, path)
    parts = _parts(spark, path)
    done = [p for p in parts if p in said.get("merged", [])]
    fresh = [p for p in parts if p not in done]
    if not fresh:
        return []
    new = _last(spark.read.schema(schema).parquet(*(f"{path}/parts/{p}" for p in fresh)), key, order)
    # an event older than the base's own does not take its place
    new = _last(new.unionByName(matching(spark, path, schema, key, new)), key, order)
    rewritten = upsert(spark, path, schema, key, new, n=n, tries=1, more={"merged": fresh})
    for p in done:
        fs, place = _fs(spark, f"{path}/parts/{p}")
        fs.delete(place, True)
    return rewritten
