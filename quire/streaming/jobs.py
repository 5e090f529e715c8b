"""Streaming deduplication and archive roll-up over arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.metrics import archive_rollup
from quire.sources import state


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive; back-pressure by files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def unique_stream(rows: DataFrame, key: str, event_time: str | None = None, keep: str = "1 day") -> DataFrame:
    """First row of each key; state is keyed, so it spreads with the keys.

    Over the whole stream without ``event_time``. With it a key is remembered for ``keep`` after
    its row's time, which bounds the state; what is older is settled by the published snapshot.
    """
    if event_time is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(event_time, keep).dropDuplicatesWithinWatermark([key])


def run_unique(rows: DataFrame, key: str, known_root: str, known_schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, event_time: str | None = None, keep: str = "1 day") -> StreamingQuery:
    """Unique rows that no published snapshot holds, batch by batch, until the input is used up."""

    def each(batch: DataFrame, number: int) -> None:
        known = state.read_snapshot(batch.sparkSession, known_root, known_schema)
        sink(batch.join(known.select(key), key, "left_anti"), number)

    return unique_stream(rows, key, event_time, keep).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_stream(children: DataFrame, archive: str = "archive_source") -> DataFrame:
    """Roll-up of archives so far (complete or update mode)."""
    return archive_rollup(children, archive)


def completed(rollup: DataFrame, expected: DataFrame, archive: str = "archive_source") -> DataFrame:
    """Archives all of whose announced children are in."""
    return rollup.join(expected, archive).where((F.col("pending") == 0) & (F.col("n_children") == F.col("n_seen")))
