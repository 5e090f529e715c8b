"""Incremental index of a target folder: what changed, what is stale, and the new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import buckets


def changes(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``change`` to the listing: cached if size, time, hash and status agree, else pending."""
    old = index.select(F.col("path_key").alias("__k"), F.col("size_bytes").alias("__s"), F.col("mtime_ns").alias("__m"), F.col("xxh64").alias("old_xxh64"), F.col("status").alias("__st"))
    same = (F.col("size_bytes") == F.col("__s")) & (F.col("mtime_ns") == F.col("__m")) & (F.coalesce("old_xxh64", F.lit("")) != "") & (F.col("__st") == "ok")
    return listing.join(old, F.col("path_key") == F.col("__k"), "left").withColumn("change", F.when(same, "cached").otherwise("pending")).drop("__k", "__s", "__m", "__st")


def stale(index: DataFrame, listing: DataFrame) -> DataFrame:
    return index.join(listing.select("path_key"), "path_key", "left_anti")


def vanished(hashes: DataFrame, listing: DataFrame) -> DataFrame:
    """Hash rows whose canonical file is no longer listed."""
    return hashes.join(listing.select(F.col("path_key").alias("canonical_zip")), "canonical_zip", "left_anti")


def counters(listing: DataFrame, index: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row: found, cached, queued, removed_index, removed_hashes."""
    seen = changes(listing, index).agg(F.count("*").alias("found"), F.count_if(F.col("change") == "cached").alias("cached"), F.count_if(F.col("change") == "pending").alias("queued"))
    return seen.crossJoin(stale(index, listing).agg(F.count("*").alias("removed_index"))).crossJoin(vanished(hashes, listing).agg(F.count("*").alias("removed_hashes")))


def merged(old: DataFrame, new: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key and the keys of ``removed`` taken out."""
    left = old.join(new.select(key), key, "left_anti")
    out = left.unionByName(new.select(old.columns))
    return out if removed is None else out.join(removed.select(key), key, "left_anti")


def refreshed(listing: DataFrame, index: DataFrame, hashed: DataFrame) -> DataFrame:
    """The next index: cached rows stay, changed rows take hash and note from ``hashed``."""
    rows = changes(listing, index).join(hashed.select("path_key", F.col("xxh64").alias("__x"), F.col("note").alias("__n")), "path_key", "left")
    kept = F.col("change") == "cached"
    return rows.select(
        "path_key",
        "size_bytes",
        "mtime_ns",
        F.when(kept, F.col("old_xxh64")).otherwise(F.col("__x")).alias("xxh64"),
        F.when(kept | F.col("__x").isNotNull(), "ok").otherwise("failed").alias("status"),
        F.when(kept, "").otherwise(F.coalesce("__n", F.lit(""))).alias("note"),
    )


INDEX = "path_key string, size_bytes long, mtime_ns long, xxh64 string, status string, note string"


def publish_changes(spark: SparkSession, root: str, listing: DataFrame, hashed: DataFrame, n: int = 64) -> list[int]:
    """Bring the index kept under ``root`` up to date; the numbers of the buckets rewritten.

    Only changed rows are put in and stale ones taken out: a run over a folder that did not change
    rewrites nothing. ``hashed`` has path_key, xxh64 and note of the changed files.
    """
    index = buckets.read(spark, root, INDEX)
    pending = changes(listing, index).where("change = 'pending'").select(listing.columns)
    return buckets.upsert(spark, root, INDEX, "path_key", refreshed(pending, index, hashed), stale(index, listing), n)


def prune_hashes(spark: SparkSession, root: str, schema: str, listing: DataFrame) -> list[int]:
    """Take out the hashes kept under ``root`` whose canonical file is no longer listed."""
    hashes = buckets.read(spark, root, schema)
    return buckets.upsert(spark, root, schema, "xxh64", spark.createDataFrame([], schema), vanished(hashes, listing))
