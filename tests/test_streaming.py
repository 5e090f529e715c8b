import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.operators import dedupe, metrics
from quire.sources import files, live
from quire.streaming import keyed

CHILD = "archive_source string, child string, is_book boolean, result string, size_bytes long"


def feed(spark, rows, schema, folder, name):
    """One more Parquet file for a stream of files to find."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def arrived(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drain(df, out, checkpoint, **how):
    query = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append")
    query = query.trigger(**(how or {"availableNow": True})).start()
    query.awaitTermination(60)
    query.stop()
    return query


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep availableNow going
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_archives_are_told_once_when_complete(spark, tmp_path, few_partitions):
    r = random.Random(6)
    children, told = [], []
    for a in range(12):
        n = r.randint(1, 6)
        told.append((f"a{a}", None, n, None, None, None))
        for c in range(n):
            children.append((f"a{a}", f"c{c}", a % 4 > 0 and r.random() < 0.7, r.choice(["packed", "duplicate", "nobook", "failed"]), r.choice([None, 5, 70])))
    events = told + [(a, c, None, b, result, size) for a, c, b, result, size in children]
    begun = [(a, c, None, b, None, size) for a, c, b, _, size in children[:5]]  # no result yet
    r.shuffle(events)
    lost = [e for e in events if e[0] == "a11"][-1]
    events = [e for e in events if e is not lost] + begun
    again = r.sample(events, 15) + [(None, "x", 1, True, "packed", 1)]
    third = len(events) // 3
    for k, part in enumerate((events[:third], events[third : 2 * third] + again[:8], events[2 * third :], again)):
        feed(spark, part, keyed.EVENT, tmp_path / "in", f"f{k}")
    stream = keyed.complete_archives(arrived(spark, tmp_path / "in", keyed.EVENT))
    drain(stream, tmp_path / "out", tmp_path / "ck")
    want = metrics.archive_rollup(spark.createDataFrame([c for c in children if c[0] != "a11"], CHILD))
    columns = ["archive_source", "n_seen", "pending", "book_total", "book_packed", "failed", "bytes", "action"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(columns).collect()))

    # a restart has the open archive's state, and what is late or repeated emits nothing again
    feed(spark, [lost, *again], keyed.EVENT, tmp_path / "in", "f9")
    drain(keyed.complete_archives(arrived(spark, tmp_path / "in", keyed.EVENT)), tmp_path / "out", tmp_path / "ck")
    want = metrics.archive_rollup(spark.createDataFrame(children, CHILD))
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_archive_without_news_expires_once(spark, tmp_path, few_partitions):
    feed(spark, [("a", None, 3, None, None, None), ("a", "c1", None, True, "packed", 4), ("b", "c1", None, False, "nobook", 2)], keyed.EVENT, tmp_path / "in", "f1")
    stream = lambda: keyed.complete_archives(arrived(spark, tmp_path / "in", keyed.EVENT), patience="1 second", keep="1 hour")
    drain(stream(), tmp_path / "out", tmp_path / "ck")
    for k in range(2):  # further batches move the clock on
        feed(spark, [("c", None, 0, None, None, None)], keyed.EVENT, tmp_path / "in", f"g{k}")
        drain(stream(), tmp_path / "out", tmp_path / "ck")
    feed(spark, [("a", "c2", None, True, "packed", 4), ("a", "c3", None, True, "packed", 4)], keyed.EVENT, tmp_path / "in", "h")
    drain(stream(), tmp_path / "out", tmp_path / "ck")
    got = sorted((r["archive_source"], r["n_seen"], r["pending"], r["bytes"], r["action"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, 2, 4, "expired"), ("b", 1, 1, 2, "expired"), ("c", 0, 0, 0, "move_nobook")]


def test_first_writers_against_the_published_index(spark, tmp_path, few_partitions):
    schema = "xxh64 string, path string, n long"
    published = spark.createDataFrame([("h1", "/z/1.zip"), ("h1", "/z/0.zip"), ("h9", "/z/9.zip"), (None, "/z/n.zip")], "xxh64 string, canonical_zip string")
    parts = [[("h1", "p1", 1), ("h2", "p2", 2)], [("h2", "p3", 3), ("h3", "p4", 4), (None, "p5", 5)], [("h3", "p6", 6), ("h9", "p7", 7), ("h4", "p8", 8)]]
    for k, part in enumerate(parts[:2]):
        feed(spark, part, schema, tmp_path / "in", f"f{k}")
    stream = lambda known: keyed.first_writers(arrived(spark, tmp_path / "in", schema), "xxh64", "path", known)
    drain(stream(published), tmp_path / "out", tmp_path / "ck")
    feed(spark, parts[2], schema, tmp_path / "in", "f2")
    query = drain(stream(published), tmp_path / "out", tmp_path / "ck")
    got = {r["path"]: (r["status"], r["canonical"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    known = published.where("xxh64 is not null").groupBy("xxh64").agg(F.min("canonical_zip").alias("canonical"))
    whole = spark.createDataFrame([x for part in parts for x in part if x[0]], schema)
    want = {r["path"]: (r["status"], r["canonical"], r["n"]) for r in dedupe.claim(whole, "xxh64", ["n", "path"], known).collect()}
    assert got == want
    # one small row of state for each key: h1, h9 from the index and h2, h3, h4 of the stream
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 5


def test_first_writers_forget(spark, tmp_path, few_partitions):
    schema = "xxh64 string, path string"
    stream = lambda: keyed.first_writers(arrived(spark, tmp_path / "in", schema), "xxh64", "path", keep="1 second")
    for k in range(2):
        feed(spark, [("h", f"p{k}")], schema, tmp_path / "in", f"f{k}")
        drain(stream(), tmp_path / "out", tmp_path / "ck")
        time.sleep(1.5)
    assert sorted((r["path"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("p0", "unique"), ("p1", "unique")]


def put(folder, sizes):
    for name, size in sizes.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)


def followed(spark, roots, where, seconds=4.0, **how):
    """Run a live scan until it is idle; the sizes of each batch's files."""
    stream = live.live_scan(spark, [str(r) for r in roots], str(where / "log"), **how)
    query = stream.drop("content").writeStream.format("parquet").option("path", str(where / "out")).option("checkpointLocation", str(where / "ck"))
    query = query.trigger(processingTime="200 milliseconds").start()
    try:
        assert live.until_idle(query, seconds, 90)
    finally:
        query.stop()
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def seen(spark, where):
    return sorted((r["path"].rsplit("/", 1)[1], r["size_bytes"]) for r in spark.read.parquet(str(where / "out")).collect())


def test_live_scan_cuts_batches_by_bytes_and_restarts(spark, tmp_path):
    put(tmp_path / "a", {"1": 10, "2": 10, "3": 10, "d/4": 100, "d/e/5": 5, "d/e/_6": 5, "d/.7": 0})
    assert followed(spark, [tmp_path / "a"], tmp_path, max_bytes=20) == [2, 2, 1, 2]
    first = seen(spark, tmp_path)
    assert first == sorted([("1", 10), ("2", 10), ("3", 10), ("4", 100), ("5", 5), ("_6", 5), (".7", 0)])
    # a restart goes on from the checkpoint; a root added by name is seen too
    put(tmp_path / "a", {"d/8": 1})
    put(tmp_path / "b", {"9": 2})
    live.add_root(str(tmp_path / "log"), str(tmp_path / "b"))
    assert followed(spark, [tmp_path / "a"], tmp_path, max_bytes=20) == [2]
    assert seen(spark, tmp_path) == sorted([*first, ("8", 1), ("9", 2)])


def test_live_reader_replays_and_merges_its_log(tmp_path, monkeypatch):
    put(tmp_path / "a", {f"{k:02}": k for k in range(9)})
    options = {"path": str(tmp_path / "a"), "log": str(tmp_path / "log"), "maxfiles": "2"}
    reader = live._LiveReader(options)
    offsets = [reader.latestOffset()["batch"] for _ in range(3)]
    assert offsets == [1, 2, 3]
    names = lambda r, a, b: sorted(f[1][-2:] for load in r.partitions({"batch": a}, {"batch": b}) for f in load.files)
    assert names(reader, 1, 3) == ["02", "03", "04", "05"]
    # another reader, as after a crash, gives the same files for the same offsets and goes on behind them
    again = live._LiveReader(options)
    assert again.latestOffset() == {"batch": 4} and names(again, 1, 3) == ["02", "03", "04", "05"] and names(again, 3, 4) == ["06", "07"]
    monkeypatch.setattr(live, "MERGED", 3)
    again.commit({"batch": 4})
    assert again._entries("batch") == [4] and again._entries("done") == [3]
    third = live._LiveReader(options)
    assert third.latestOffset() == {"batch": 5} and names(third, 4, 5) == ["08"]
    assert third.latestOffset() == {"batch": 5}
    put(tmp_path / "a", {"new": 1})
    assert third.latestOffset() == {"batch": 6} and names(third, 5, 6) == ["ew"]


def test_loads_are_even():
    files = [["r", str(k), s] for k, s in enumerate([100, 1, 1, 1, 30, 30, 40, 0])]
    loads = live.packed(files, 60)
    assert sorted(f[1] for load in loads for f in load) == [str(k) for k in range(8)]
    assert sorted(sum(f[2] for f in load) for load in loads)[-1] == 100 and len(loads) == 4


def test_balanced_scan_equals_the_walk(spark, tmp_path):
    put(tmp_path / "a", {f"deep/{'d/' * (k % 5)}f{k}": 100 * k for k in range(40)} | {"_x": 3, ".y/z": 4})
    (tmp_path / "a" / "link").symlink_to(tmp_path / "a" / "deep")
    columns = ["path", "source_root", "size_bytes", "mtime_ns", "content"]
    want = sorted(map(tuple, files.scan(spark, [str(tmp_path / "a")]).select(columns).collect()))
    got = files.balanced_scan(spark, [str(tmp_path / "a")], task_bytes=9000)
    assert sorted(map(tuple, got.select(columns).collect())) == want and len(want) == 42
    loads = [sum(len(r["content"]) for r in part) for part in got.rdd.glom().collect()]
    assert sum(x > 0 for x in loads) >= 9 and max(loads) <= 9000
    few = files.listing(spark, [str(tmp_path / "a")], rounds=2)  # the last round walks on
    assert sorted(r["path"] for r in few.collect()) == [r[0] for r in want]
    assert files.balanced_scan(spark, [str(tmp_path / "none")]).count() == 0


class Stored:
    """A state variable that counts the calls it gets."""

    calls = 0

    def __init__(self):
        self.value, self.map = None, {}

    def told(self, x=None):
        Stored.calls += 1
        return x

    def get(self):
        return self.told(self.value)

    def exists(self):
        return self.told(self.value is not None)

    def update(self, value):
        self.value = self.told(value)

    def clear(self):
        self.value, self.map = self.told(), {}

    def containsKey(self, key):
        return self.told(key in self.map)

    def updateValue(self, key, value):
        self.map[key] = self.told(value)


class Handle:
    def __init__(self):
        self.tally, self.children = Stored(), Stored()

    def getValueState(self, *_):
        return self.tally

    def getMapState(self, *_):
        return self.children

    def registerTimer(self, _):
        Stored.calls += 1

    def getCurrentProcessingTimeInMs(self):
        return 1


@pytest.mark.parametrize("most", [10_000, 7])
def test_an_archive_of_one_batch_asks_the_state_little(monkeypatch, most):
    monkeypatch.setattr(keyed, "HELD", most, raising=False)
    handle, tally = Handle(), keyed.ArchiveTally(1000, 1000)
    tally.init(handle)
    fields = ["archive_source", "child", "announced", "is_book", "result", "size_bytes"]
    event = lambda *x: Row(*fields)("a", *x)
    child = lambda k: event(f"c{k}", None, True, "packed", 1)
    Stored.calls = 0
    out = list(tally.handleInputRows(("a",), iter([event(None, 40, None, None, None), *map(child, range(40)), *map(child, range(9))]), handle))
    assert [(r["n_seen"], r["book_packed"], r["bytes"], r["action"]) for r in out] == [(40, 40, 40, "delete_eligible")]
    assert most < 40 or Stored.calls <= 5
    other = Handle()
    tally.init(other)
    assert list(tally.handleInputRows(("a",), iter(map(child, [*range(30), *range(20)])), other)) == [] and len(other.children.map) == 30
    out = list(tally.handleInputRows(("a",), iter([*map(child, range(40)), event(None, 40, None, None, None)]), other))
    assert [(r["n_seen"], r["bytes"]) for r in out] == [(40, 40)] and not other.children.map
