"""Counters, roll-ups and the progress snapshot as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import text as T

GB = 1_073_741_824


def stage_counters(events: DataFrame, stage: str, failed: Column) -> DataFrame:
    """Processed and failed by stage; a failed one counts as processed too."""
    return events.groupBy(stage).agg(F.count("*").alias("processed"), F.count_if(failed).alias("errors"))


def result_counters(tasks: DataFrame, result: str = "result") -> DataFrame:
    return tasks.groupBy(result).agg(F.count("*").alias("n"))


def book_counters(files: DataFrame, path: str = "path") -> DataFrame:
    """By extension alone, as classified, and done, with bytes."""
    return files.agg(
        F.count_if(T.suffix_of(F.col(path)).isin(C.BOOK_EXTENSIONS)).alias("provisional"),
        F.count_if("is_book").alias("seen"),
        F.count_if(F.col("is_book") & F.col("result").isNotNull()).alias("done"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_seen"),
        F.coalesce(F.sum(F.when(F.col("result").isNotNull(), F.col("size_bytes"))), F.lit(0)).alias("bytes_done"),
    )


def archive_rollup(children: DataFrame, archive: str = "archive_source") -> DataFrame:
    """By archive: pending, books, packed, failed and what becomes of it. Nothing is deleted."""
    done = F.col("result").isNotNull()
    out = children.where(F.col(archive).isNotNull()).groupBy(archive).agg(
        F.count("*").alias("n_seen"),
        F.count_if(~done).alias("pending"),
        F.count_if("is_book").alias("book_total"),
        F.count_if(F.col("is_book") & F.col("result").isin("packed", "duplicate", "duplicate_temp")).alias("book_packed"),
        F.count_if((F.col("result") == "failed") | (F.col("is_book") & done & ~F.col("result").isin("packed", "duplicate", "duplicate_temp"))).alias("failed"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
    )
    return out.withColumn("action", F.when(F.col("pending") > 0, "wait").when(F.col("book_total") > 0, "delete_eligible").otherwise("move_nobook"))


def snapshot(totals: DataFrame, elapsed: Column) -> DataFrame:
    """Progress from one row of totals (bytes_seen, bytes_done, seen, done, queued_a2, a2, a3, queued)."""
    seen, done = F.col("bytes_seen") / GB, F.col("bytes_done") / GB
    rate = F.when((elapsed > 0) & (done > 0), done / elapsed * 60).otherwise(0.0)
    left = F.greatest(F.lit(0.0), seen - done)
    eta = F.when((rate > 0) & (left > 0), F.floor(left / rate * 60)).when((left == 0) & (done > 0), 0)
    per_archive = F.least(F.lit(64.0), F.when(F.col("a2") > 0, F.col("a3") / F.greatest(F.lit(1), F.col("a2"))).otherwise(1.0))
    ratio = F.least(F.lit(1.0), F.when(F.col("a3") > 0, F.col("seen") / F.greatest(F.lit(1), F.col("a3"))).otherwise(1.0))
    backlog = F.greatest(F.lit(0), F.col("seen") - F.col("done")) + F.col("queued") + F.floor(F.col("queued_a2") * per_archive * ratio)
    return totals.select(
        "seen",
        "done",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_divide(done, seen) * 100, F.lit(0.0)))).alias("pct"),
        F.bround(seen, 2).alias("gb_seen"),
        F.bround(done, 2).alias("gb_done"),
        F.bround(rate, 2).alias("gb_per_min"),
        T.duration_hms(eta).alias("eta"),
        backlog.cast("long").alias("backlog"),
        (F.col("done") + backlog).cast("long").alias("estimated_total"),
    )


def genre_histogram(rows: DataFrame, genre: str = "genre") -> DataFrame:
    return rows.groupBy(genre).agg(F.count("*").alias("n")).orderBy(F.desc("n"), genre)


def title_quality(rows: DataFrame, title: str = "title", author: str = "author") -> DataFrame:
    """Counts of titles that start with the author's first word, unknown authors, numeric ends."""
    first, unknown = F.get(F.split(F.trim(F.col(author)), r"\s+"), F.lit(0)), F.startswith(F.lower(author), F.lit("неизвестн"))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(~unknown & (first != "") & F.startswith(F.col(title), first)).alias("author_in_title"),
        F.count_if(unknown).alias("unknown_author"),
        F.count_if(F.col(title).rlike(r"\.\d{4,}$")).alias("numeric_suffix"),
    )


def largest_member(members: DataFrame, archive: str, path: str = "member", size: str = "size", place: str = "pos") -> DataFrame:
    """The largest member of each archive, books before others, the first of equals."""
    rank = F.struct(T.suffix_of(F.col(path)).isin(C.BOOK_EXTENSIONS).alias("b"), F.col(size).alias("s"), (-F.col(place)).alias("p"))
    return members.groupBy(archive).agg(F.max_by(F.struct(path, size), rank).alias("m")).select(archive, "m.*")


def model_result_kinds(lines: DataFrame, line: str = "value") -> DataFrame:
    """How often a log names each kind of model result that comes with an object."""
    kind = F.regexp_extract(line, r"A6 (full_ok|iter_ok|fast_ok|fast_fallback) .*?\{.*\}", 1)
    return lines.select(kind.alias("kind")).where("kind <> ''").groupBy("kind").agg(F.count("*").alias("n"))
