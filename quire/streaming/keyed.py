"""Operators with arbitrary keyed state: archives told once when complete, first writers by key.

State lies in Spark's state store, split by key and checkpointed with the offsets, so a restart goes on
where the last finished batch ended and a lost executor costs a replay of one batch. Both need the
RocksDB provider (``prepare``), which keeps state on disk and not on the heap.

Timers run on the clock, so a query goes on with empty batches to see them expire. For a run that ends by
itself (availableNow) set spark.sql.streaming.noDataMicroBatches.enabled to false: timers then wait
for the next batch with rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = 10_000
PACKED = ("packed", "duplicate", "duplicate_temp")
EVENT = "archive_source string, child string, announced long, is_book boolean, result string, size_bytes long"
CLOSED = "archive_source string, n_seen long, pending long, book_total long, book_packed long, failed long, bytes long, action string"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def millis(spell: str) -> int:
    """Milliseconds of a spell like '10 minutes'."""
    n, unit = spell.split()
    return round(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)


class ArchiveTally(StatefulProcessor):
    """Counts an archive's children down and emits one row when all announced ones have a result.

    Children are told apart by name, so an event that comes again changes nothing; they may come before
    the announcement. An archive without news for ``patience`` is emitted as ``expired``. A closed
    archive is remembered for ``keep``: what comes late is dropped and cannot emit it again.

    Each call of the state is a turn to the JVM and back, so names of a batch are held in the task, HELD
    at most, and stored only where their archive is still open at its end; stored names are looked
    up only for archives that have some.
    """

    def __init__(self, patience: int, keep: int):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tally = handle.getValueState("tally", "announced long, done long, book_total long, book_packed long, failed long, bytes long, deadline long, closed boolean")
        self.children = handle.getMapState("children", "child string", "done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = self.tally.get()
        announced, done, books, packed, failed, size, deadline, closed = told or (None, 0, 0, 0, 0, 0, 0, False)
        if closed:
            return
        news, stored, fresh = False, done > 0, set()
        for _, child, n, is_book, result, n_bytes in rows:
            if n is not None:
                news, announced = True, max(n, announced or 0)
            if child is None or result is None or child in fresh or (stored and self.children.containsKey((child,))):
                continue
            news = True
            fresh.add(child)
            if len(fresh) >= HELD:
                self._store(fresh)
                stored = True
            book, good = bool(is_book), result in PACKED
            done, books, packed, size = done + 1, books + book, packed + (book and good), size + (n_bytes or 0)
            failed += result == "failed" or (book and not good)
        now = timerValues.getCurrentProcessingTimeInMs()
        if announced is not None and done >= announced:
            yield self._close(key, done, 0, books, packed, failed, size, now, stored)
        elif news:
            self._store(fresh)
            deadline = now + self.patience
            self.handle.registerTimer(deadline)
            self.tally.update((announced, done, books, packed, failed, size, deadline, False))

    def _store(self, fresh: set[str]) -> None:
        for child in fresh:
            self.children.updateValue((child,), (True,))
        fresh.clear()

    def _close(self, key, done: int, pending: int, books: int, packed: int, failed: int, size: int, now: int, stored: bool = True) -> Row:
        action = "expired" if pending else "delete_eligible" if books else "move_nobook"
        if stored:
            self.children.clear()
        self.tally.update((done + pending, done, books, packed, failed, size, now + self.keep, True))
        self.handle.registerTimer(now + self.keep)
        return Row(archive_source=key[0], n_seen=done, pending=pending, book_total=books, book_packed=packed, failed=failed, bytes=size, action=action)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.tally.exists():
            return
        announced, done, books, packed, failed, size, deadline, closed = self.tally.get()
        if expiredTimerInfo.getExpiryTimeInMs() < deadline:
            return  # there was news after this timer was set
        if closed:
            self.tally.clear()
        else:
            # what never was announced has at least one child to wait for
            yield self._close(key, done, max(1, (announced or 0) - done), books, packed, failed, size, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def announcements(archives: DataFrame, archive: str, n_children: Column) -> DataFrame:
    """Events that tell how many children an archive has."""
    return archives.select(F.col(archive).alias("archive_source"), F.lit(None).cast("string").alias("child"), n_children.cast("long").alias("announced"), F.lit(None).cast("boolean").alias("is_book"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("long").alias("size_bytes"))


def results(children: DataFrame, archive: str, child: Column) -> DataFrame:
    """Events of children with is_book, result and size_bytes; a null result says nothing yet."""
    return children.select(F.col(archive).alias("archive_source"), child.alias("child"), F.lit(None).cast("long").alias("announced"), "is_book", "result", F.col("size_bytes").cast("long"))


def complete_archives(events: DataFrame, patience: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """One row for each archive, when its last child is done, as ``metrics.archive_rollup`` gives it.

    ``events``: a stream of EVENT rows, in any order. Rows without an archive are left out.
    """
    prepare(events.sparkSession)
    columns = [part.split()[0] for part in EVENT.split(", ")]
    held = events.where(F.col("archive_source").isNotNull()).select(columns).groupBy("archive_source")
    return held.transformWithState(ArchiveTally(millis(patience), millis(keep)), CLOSED, "Append", "ProcessingTime")


class FirstWriter(StatefulProcessor):
    """The first row of a key is unique, all later ones duplicates of it."""

    def __init__(self, columns: list[str], key: str, canonical: str, keep: int | None):
        self.columns, self.key, self.canonical, self.keep = columns, key, canonical, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "canonical string", *([] if self.keep is None else [self.keep]))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.first.update((initialState["canonical"],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get()
        known = None if known is None else known[0]
        mine = known is None
        for r in rows:
            if mine:
                known = r[self.canonical]
                self.first.update((known,))
            yield Row(**{c: r[c] for c in self.columns}, status="unique" if mine else "duplicate", canonical=known)
            mine = False

    def close(self) -> None:
        pass


def first_writers(rows: DataFrame, key: str, canonical: str, published: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """``rows`` of a stream with ``status`` and ``canonical``, as ``dedupe.claim`` tells them of a table.

    ``published`` (key, canonical_zip) is taken into the state when the query begins, once; later
    batches and restarts look up only the keys that they hold. With ``keep`` a key is forgotten that
    long after it was claimed, which bounds the state. Rows without a key are left out: none of
    them can be a duplicate. ``canonical`` names the column that becomes the canonical value; where it
    is null a row claims nothing.
    """
    spark = rows.sparkSession
    prepare(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", status string, canonical string"
    start = None
    if published is not None:
        # one row for each key: a repeated key keeps its least canonical value
        start = published.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("canonical_zip").alias("canonical")).groupBy(key)
    processor = FirstWriter(rows.columns, key, canonical, None if keep is None else millis(keep))
    return rows.where(F.col(key).isNotNull()).groupBy(key).transformWithState(processor, schema, "Append", "ProcessingTime", start)
