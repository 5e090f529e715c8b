import os

import pytest
from pyspark.sql import functions as F

from quire.operators import dedupe, index_sync
from quire.plans import catalogue
from quire.sources import buckets, state

SCHEMA = "k string, v long"


def table(spark, pairs):
    return spark.createDataFrame([(f"k{k}", v) for k, v in pairs], SCHEMA)


def held(spark, root):
    return {r["k"]: r["v"] for r in buckets.read(spark, root, SCHEMA).collect()}


def test_upsert_rewrites_only_changed_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    assert held(spark, root) == {}
    first = buckets.upsert(spark, root, SCHEMA, "k", table(spark, [(k, k) for k in range(200)]), n=16)
    assert len(first) == 16
    before = dict(state.current(spark, root)[1]["buckets"])
    touched = buckets.upsert(spark, root, SCHEMA, "k", table(spark, [(3, 30), (777, 7)]), table(spark, [(5, 0), (3, 0), (12345, 0)]), n=99)
    after = state.current(spark, root)[1]["buckets"]
    assert 1 <= len(touched) <= 4
    assert {int(k) for k in after if after[k] != before[k]} == set(touched)
    assert held(spark, root) == {f"k{k}": k for k in range(200) if k != 5} | {"k3": 30, "k777": 7}
    wanted = spark.createDataFrame([("k3",), ("k777",), ("none",), (None,)], "k string")
    assert {r["k"]: r["v"] for r in buckets.matching(spark, root, SCHEMA, "k", wanted).collect()} == {"k3": 30, "k777": 7}
    # the version before can still be read by whoever began with it
    assert all(os.path.isdir(f"{root}/{p}") for p in before.values())
    for bad in ([("a", 1), ("a", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            buckets.upsert(spark, root, SCHEMA, "k", spark.createDataFrame(bad, SCHEMA))
    everything = buckets.read(spark, root, SCHEMA)
    buckets.upsert(spark, root, SCHEMA, "k", table(spark, []), everything)
    assert held(spark, root) == {}


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    buckets.upsert(spark, root, SCHEMA, "k", table(spark, [(1, 1)]), n=2)
    real, other = buckets.publish, []

    def late(spark, at, after, said):
        if not other:  # another writer is first, once
            other.append(True)
            buckets.upsert(spark, root, SCHEMA, "k", table(spark, [(2, 2), (3, 3)]))
        return real(spark, at, after, said)

    monkeypatch.setattr(buckets, "publish", late)
    buckets.upsert(spark, root, SCHEMA, "k", table(spark, [(3, 33), (4, 4)]))
    assert held(spark, root) == {"k1": 1, "k2": 2, "k3": 33, "k4": 4}


def test_status_log_is_merged_while_it_is_read(spark, tmp_path):
    root, schema = str(tmp_path / "log"), "task_id string, status string, at long"
    events = lambda *rows: spark.createDataFrame(list(rows), schema)
    now = lambda: {r["task_id"]: r["status"] for r in buckets.latest_status(spark, root, schema, "task_id", ["at"]).collect()}
    assert now() == {} and buckets.compact(spark, root, schema, "task_id", ["at"]) == []
    buckets.append_events(events(("a", "unique", 1), ("b", "unique", 1)), root)
    buckets.append_events(events(("a", "packed", 5)), root)
    assert now() == {"a": "packed", "b": "unique"}
    assert buckets.compact(spark, root, schema, "task_id", ["at"], n=4)
    assert now() == {"a": "packed", "b": "unique"}
    reader = buckets.latest_status(spark, root, schema, "task_id", ["at"])
    # an event that comes late but is older changes nothing
    buckets.append_events(events(("a", "tags_done", 3), ("c", "failed", 2)), root)
    assert now() == {"a": "packed", "b": "unique", "c": "failed"}
    touched = buckets.compact(spark, root, schema, "task_id", ["at"])
    assert now() == {"a": "packed", "b": "unique", "c": "failed"} and len(touched) <= 2
    assert {r["task_id"]: r["status"] for r in reader.collect()} == {"a": "packed", "b": "unique"}
    assert len(buckets._parts(spark, root)) == 1  # parts of the merge before are gone
    os.makedirs(f"{root}/parts/half")  # a part whose writer died
    buckets.append_events(events(("b", "packed", 9)), root)
    assert now()["b"] == "packed" and len(buckets._parts(spark, root)) == 2
    assert buckets.read(spark, root, schema).agg(F.count("*")).first()[0] == 3


def test_index_changes_rewrite_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "index")
    listing = lambda rows: spark.createDataFrame(rows, "path_key string, size_bytes long, mtime_ns long")
    hashed = lambda rows: spark.createDataFrame(rows, "path_key string, xxh64 string, note string")
    files = [(f"/t/{k}.zip", k, k) for k in range(60)]
    index_sync.publish_changes(spark, root, listing(files), hashed([(f[0], f"h{f[1]}", "") for f in files]), n=16)
    assert index_sync.publish_changes(spark, root, listing(files), hashed([])) == []
    files = [*files[1:], ("/t/new.zip", 1, 1)]
    files[0] = ("/t/1.zip", 99, 1)
    touched = index_sync.publish_changes(spark, root, listing(files), hashed([("/t/1.zip", "h99", ""), ("/t/new.zip", None, "bad_zip")]))
    got = {r["path_key"]: (r["size_bytes"], r["xxh64"], r["status"]) for r in buckets.read(spark, root, index_sync.INDEX).collect()}
    assert len(touched) <= 3 and got == {f"/t/{k}.zip": (k, f"h{k}", "ok") for k in range(2, 60)} | {"/t/1.zip": (99, "h99", "ok"), "/t/new.zip": (1, None, "failed")}
    hashes = str(tmp_path / "hashes")
    buckets.upsert(spark, hashes, catalogue.HASH_SCHEMA, "xxh64", spark.createDataFrame([("a", "/t/1.zip", "", "", ""), ("b", "/t/0.zip", "", "", "")], catalogue.HASH_SCHEMA))
    assert len(index_sync.prune_hashes(spark, hashes, catalogue.HASH_SCHEMA, listing(files))) == 1
    assert [r["xxh64"] for r in buckets.read(spark, hashes, catalogue.HASH_SCHEMA).collect()] == ["a"]


def test_names_of_earlier_runs_are_not_given_again(spark):
    rows = spark.createDataFrame([(d, h, k) for k, (d, h) in enumerate([("a.zip", "abcdefgh9"), ("a.zip", "abcdefgh9"), ("b.zip", "x"), ("c.zip", "abcdefgh9"), ("c.zip", None), ("c_abcdefgh.zip", "q")])], "d string, h string, n int")
    taken = spark.createDataFrame([("a.zip",), ("a_1.zip",), ("a_3.zip",), ("a_abcdefgh.zip",), ("a_abcdefgh_2.zip",), ("c_abcdefgh.zip",), ("z_1.zip",), (None,)], "name string")
    stem, end = lambda x: F.regexp_replace(x, r"\.zip$", ""), lambda _: F.lit(".zip")
    got = [r["unique_dest"] for r in dedupe.unique_names(rows, "d", ["n"], stem, end, taken).orderBy("n").collect()]
    assert got == ["a_2.zip", "a_4.zip", "b.zip", "c.zip", "c_1.zip", "c_abcdefgh_1.zip"]
    got = [r["unique_dest"] for r in dedupe.unique_names_by_hash(rows, "d", "h", ["n"], stem, end, taken).orderBy("n").collect()]
    assert got == ["a_abcdefgh_1.zip", "a_abcdefgh_3.zip", "b.zip", "c.zip", "c_x.zip", "c_abcdefgh_q.zip"]
    assert not set(got) & {r["name"] for r in taken.collect()}


def test_two_runs_name_different_books_apart(spark, tmp_path):
    for run, body in (("one", "Chapter one. " * 30), ("two", "Another text, chapter two. " * 30)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "Ann Author - The Title.txt").write_text(body)
        catalogue.run(spark, [str(tmp_path / run)], str(tmp_path / "state"), catalogue.Config(target="/lib", task_bytes=None if run == "one" else 1 << 20))
    names = sorted(r["canonical_zip"] for r in buckets.read(spark, str(tmp_path / "state" / "hash_index"), catalogue.HASH_SCHEMA).collect())
    assert len(names) == len(set(names)) == 2 and sum(n.endswith("/The Title.zip") for n in names) == 1
    again = catalogue.run(spark, [str(tmp_path / "two")], str(tmp_path / "state"), catalogue.Config(target="/lib")).collect()
    assert [r["status"] for r in again] == ["duplicate"]
