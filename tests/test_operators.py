import gzip
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import content as B
from quire.operators import classify, dedupe, enrich, index_sync, metrics, model
from quire.operators import metadata as M
from quire.plans import catalogue
from quire.sources import archives, files, state
from quire.streaming import jobs


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, body in members.items():
            box.writestr(name, body)
    return out.getvalue()


def tarred(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as box:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            box.addfile(info, io.BytesIO(body))
    return out.getvalue()


EPUB = zipped({"META-INF/container.xml": '<x full-path="c.opf"/>', "c.opf": "<dc:title>Dune</dc:title><dc:creator>Frank Herbert</dc:creator><dc:subject>sf_action</dc:subject>", "b.xhtml": "<p>second</p>", "a.html": "<p>first</p>"})
FB2 = '<?xml version="1.0" encoding="windows-1251"?><book-title>Тайна</book-title><genre>поэзия</genre><first-name>Иван</first-name><last-name>Петров</last-name>'.encode("cp1251")


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "_hidden.txt").write_text("Chapter one")
    (root / ".dot.txt").write_text("no signals")
    (root / "book.epub").write_bytes(EPUB)
    (root / "sub" / "copy.epub").write_bytes(EPUB)
    (root / "sub" / "t.fb2").write_bytes(FB2)
    (root / "empty.txt").write_bytes(b"")
    (root / "12345").write_bytes(b"%PDF-1.7 x")
    (root / "nul").write_bytes(b"\0" * 1024)
    (root / "pic.jpg").write_bytes(b"\xff\xd8")
    (root / "side.txt").write_text("plain words")
    (root / "side.fbd").write_text("<x/>")
    (root / "nested.zip").write_bytes(zipped({"inner.tar.gz": tarred({"d/a.txt": b"Prologue of a book"}), "b.epub": EPUB, "../evil.txt": "x"}))
    (root / "bad.zip").write_bytes(b"PK\x03\x04 broken")
    (root / "void.zip").write_bytes(zipped({}))
    os.symlink(root / "book.epub", root / "link.epub")
    return str(root)


def test_scan_sees_hidden_names_and_no_links(spark, library):
    names = {os.path.basename(r["path"]) for r in files.scan(spark, [library, library]).collect()}
    assert {"_hidden.txt", ".dot.txt", "copy.epub"} <= names and "link.epub" not in names
    rows = files.scan(spark, [library], head_bytes=4).where("path like '%12345'").collect()
    assert [(bytes(r["content"]), r["size_bytes"]) for r in rows] == [(b"%PDF", 10)]
    assert files.scan(spark, [library + "/none"]).count() == 0


def test_archives_explode_nested(spark, library):
    found = {(tuple(r["archive_chain"]), r["member"]): r for r in archives.explode(files.scan(spark, [library]).where("path like '%.zip'")).collect()}
    assert found[("nested.zip", "inner.tar.gz"), "d/a.txt"]["size"] == 18
    assert (("nested.zip",), "../evil.txt") in found
    assert found[("bad.zip",), ""]["note"].startswith("bad_archive") and found[("void.zip",), ""]["note"] == "empty_archive"
    notes = [r["note"] for r in archives.explode(files.scan(spark, [library]).where("path like '%nested.zip'"), most_depth=1).collect()]
    assert "too_deep" in notes
    assert "limit_reached" in [r["note"] for r in archives.explode(files.scan(spark, [library]).where("path like '%nested.zip'"), most_members=1).collect()]


def test_classify_in_order(spark, library):
    got = {os.path.basename(r["path"]): (r["is_book"], r["reason"]) for r in classify.classify(files.scan(spark, [library])).collect()}
    assert got["_hidden.txt"] == (True, "text_book_signals") and got[".dot.txt"] == (False, "text_no_book_signals")
    assert got["empty.txt"] == (False, "empty_file") and got["12345"] == (True, "book_filetype:application/pdf") and got["nul"] == (False, "tiny_unknown_binary:no_ext")
    assert got["pic.jpg"] == (False, "nonbook_ext:.jpg") and got["t.fb2"] == (True, "book_ext:.fb2") and got["side.txt"] == (True, "text_fbd_sidecar")
    assert got["book.epub"] == (True, "book_filetype:application/zip") and got["side.fbd"] == (False, "nonbook_ext:.fbd")


def test_kinds(spark):
    kind = lambda k, m, e: spark.range(1).select(classify.kind_is_book(F.lit(k), F.lit(m), F.lit(e)), classify.kind_is_archive(F.lit(k), F.lit(m)), classify.kind_is_nonbook(F.lit(k), F.lit(m), F.lit(e))).first()
    assert tuple(kind("pdf", "application/pdf", "")) == (True, False, False)
    assert tuple(kind("zip", "application/zip", ".epub")) == (True, True, False)
    assert tuple(kind("zip", "application/zip", ".zip")) == (False, True, False)
    assert tuple(kind("png", "image/png", "")) == (False, False, True) and tuple(kind("", "", "")) == (False, False, False)


def test_tags_and_text():
    assert B.tags_of(EPUB, ".epub") == {"title": "Dune", "author": "Frank Herbert", "genre": "sf_action"}
    assert B.tags_of(FB2, ".fb2") == {"title": "Тайна", "author": "Иван Петров", "genre": "поэзия"}
    assert B.tags_of(b"PK\x03\x04", ".epub") == {"title": "", "author": "", "genre": ""}
    assert B.text_of(EPUB, ".epub", 100) == "second" and B.text_of(EPUB, ".epub", 100, True) == "first\nsecond"
    assert B.payload_hash(zipped({}))[1] == "empty_zip" and B.payload_hash(b"x")[1] == "bad_zip"
    assert B.payload_hash(zipped({"big.bin": "x" * 99, "b.epub": "y"}))[0] == B.payload_hash(zipped({"b.epub": "y"}))[0]


def test_run_is_whole_and_again_finds_copies(spark, library, tmp_path):
    found = catalogue.run(spark, [library], str(tmp_path / "state")).collect()
    by = {}
    for r in found:
        by.setdefault(r["status"], []).append(r)
    assert sum(1 for r in by["duplicate"] + by["duplicate_temp"]) == 2
    dune = next(r for r in by["packed"] if r["path"].endswith("/book.epub"))
    assert dune["dest"] == "/library/Фантастика/F/Frank Herbert/book.zip" and dune["source"] == "tags"
    assert any(r["status"] == "failed" and r["dest"].startswith("/library/Error") for r in found)
    assert sorted(os.listdir(library)) == sorted(os.listdir(library))
    again = catalogue.run(spark, [library], str(tmp_path / "state"))
    assert again.where("status = 'packed'").count() == 0
    assert state.read_snapshot(spark, str(tmp_path / "state" / "hash_index"), catalogue.HASH_SCHEMA).count() == len(by["packed"])


def test_claim(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 4), (None, 5), ("k", 6)], "h string, n int")
    known = spark.createDataFrame([("k", 0)], "h string, canonical int")
    got = {r["n"]: (r["status"], r["canonical"]) for r in dedupe.claim(rows, "h", ["n"], known).collect()}
    assert got == {3: ("duplicate", 1), 1: ("unique", 1), 2: ("unique", 2), 4: ("unique", 4), 5: ("unique", 5), 6: ("duplicate", 0)}


def test_unique_names(spark):
    rows = spark.createDataFrame([("x.zip", "aaaaaaaa1", k) for k in range(3)] + [("x.zip", "bbbbbbbb2", 3), ("y.zip", None, 4)], "d string, h string, n int")
    stem, end = F.lit("x"), F.lit(".zip")
    assert [r["unique_dest"] for r in dedupe.unique_names(rows.where("d = 'x.zip'"), "d", ["n"], stem, end).orderBy("n").collect()] == ["x.zip", "x_1.zip", "x_2.zip", "x_3.zip"]
    got = [r["unique_dest"] for r in dedupe.unique_names_by_hash(rows, "d", "h", ["n"], stem, end).orderBy("n").collect()]
    assert got == ["x.zip", "x_aaaaaaaa.zip", "x_aaaaaaaa_1.zip", "x_bbbbbbbb.zip", "y.zip"]


def test_unique_names_that_are_asked_for(spark):
    rows = spark.createDataFrame([(d, "abcdefgh9", k) for k, d in enumerate(["a.zip", "a.zip", "a_1.zip", "a.zip", "a_3.zip", "a_1.zip", "a_abcdefgh.zip", "a_abcdefgh_1.zip", "b_.zip", "b_.zip"])], "d string, h string, n int")
    stem, end = F.regexp_replace("d", r"\.zip$", ""), F.lit(".zip")
    got = [r["unique_dest"] for r in dedupe.unique_names(rows, "d", ["n"], stem, end).orderBy("n").collect()]
    assert got == ["a.zip", "a_2.zip", "a_1.zip", "a_4.zip", "a_3.zip", "a_1_1.zip", "a_abcdefgh.zip", "a_abcdefgh_1.zip", "b_.zip", "b__1.zip"]
    got = [r["unique_dest"] for r in dedupe.unique_names_by_hash(rows, "d", "h", ["n"], stem, end).orderBy("n").collect()]
    assert got == ["a.zip", "a_abcdefgh_2.zip", "a_1.zip", "a_abcdefgh_3.zip", "a_3.zip", "a_1_abcdefgh.zip", "a_abcdefgh.zip", "a_abcdefgh_1.zip", "b_.zip", "b__abcdefgh.zip"]


def test_snapshot_survives_a_crash(spark, tmp_path):
    root = str(tmp_path / "s")
    assert state.read_snapshot(spark, root, "k string").count() == 0
    assert state.write_snapshot(spark.createDataFrame([("a",)], "k string"), root) == 1
    spark.createDataFrame([("half",)], "k string").write.parquet(f"{root}/data-half")  # died before its marker
    with pytest.raises(state.Conflict):
        state.publish(spark, root, 0, {"data": "data-half"})  # began before the first version
    assert [r["k"] for r in state.read_snapshot(spark, root, "k string").collect()] == ["a"]
    assert state.write_snapshot(spark.createDataFrame([("b",)], "k string"), root) == 2
    assert [r["k"] for r in state.read_snapshot(spark, root, "k string").collect()] == ["b"]
    with open(f"{root}/DONE.3", "w") as f:
        f.write('{"data": "data-ha')  # died in its marker
    assert [r["k"] for r in state.read_snapshot(spark, root, "k string").collect()] == ["b"]
    assert state.write_snapshot(spark.createDataFrame([("c",)], "k string"), root) == 4
    assert [r["k"] for r in state.read_snapshot(spark, root, "k string").collect()] == ["c"]
    events = spark.createDataFrame([("/x/_TempPipeline/a", "duplicate"), ("/x/a", "duplicate"), ("/x/_TempPipeline/b", "packed")], "source_path string, status string")
    assert [r["status"] for r in state.migrated(events).collect()] == ["duplicate_temp", "duplicate", "packed"]


def test_archive_bomb_stops(spark):
    bomb = gzip.compress(b"\0" * (64 << 20))
    assert [n for *_, n in archives.walk("x.gz", bomb, 8, 100, 1 << 20)] == ["limit_reached"]
    assert [(m, c) for _, m, c, _ in archives.walk("x.txt.gz", gzip.compress(b"hi"), 8, 100, 1 << 20)] == [("x.txt", b"hi")]


def test_model_flow(spark):
    cache = spark.createDataFrame([], "cache_key string, payload_json string")
    strong, weak = '{"title": "Dune", "genre": "poetry", "confidence": 4.5}', '{"title": "", "genre": "", "confidence": 1}'
    data = [("strong", "x" * 30, "full"), ("weak", "x" * 30, "full"), ("none", "x" * 30, "full"), ("none2", "12", "full"), ("g", "", "genre_only"), ("g0", "", "genre_only"), ("s", "", "skip:metadata_sufficient")]
    rows = spark.createDataFrame([(c, s, d, "Old", "A", "Unknown", 0.3, "filename") for c, s, d in data], "context string, snippet string, lm_decision string, title string, author string, genre string, confidence double, source string")
    fast = lambda rs: [strong if r == "strong" else weak if r == "weak" else None for r in rs]
    asking = model.Asking(fast=fast, full=lambda rs: [strong if r.startswith("x") else None for r in rs], genre=lambda rs: ['{"genre": "poetry"}' if r == "g" else None for r in rs])
    out, fresh = model.ask(rows, asking, cache)
    got = {r["context"]: r for r in out.collect()}
    assert got["strong"]["lm_stats"] == ["fast_request", "fast_ok", "processed"] and got["strong"]["title"] == "Dune" and got["strong"]["genre"] == "Поэзия"
    assert got["weak"]["lm_stats"] == ["fast_request", "fast_fallback", "full_request", "full_ok", "processed"]
    assert got["none"]["lm_stats"] == ["fast_request", "fast_no_result", "full_request", "full_ok", "processed"]
    assert got["none2"]["lm_stats"][2:] == ["full_request", "full_no_result", "processed"] and got["none2"]["title"] == "Old"
    assert got["g"]["lm_stats"] == ["genre_only_request", "genre_only_ok", "processed"] and got["g"]["genre"] == "Поэзия"
    assert got["g0"]["lm_stats"][1] == "genre_only_no_result" and got["s"]["lm_stats"] == ["skipped", "processed"]
    # four contexts, one snippet, the context of none2 again, two genre requests
    assert fresh.count() == 8
    pieces = rows.withColumn("pieces", F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")))
    slow = model.iterative_provider(lambda ps: '{"title": "I", "genre": "poetry", "confidence": %d, "need_more_text": true}' % (2 * len(ps) + 1))
    out, _ = model.ask(pieces, model.Asking(fast=None, iterative=slow), cache)
    assert {r["context"]: r["lm_stats"] for r in out.collect()}["weak"] == ["iter_request", "iter_ok", "processed"]
    assert slow(['["a", "b", "c"]']) == ['{"title": "I", "genre": "poetry", "confidence": 5, "need_more_text": true}']
    none, _ = model.ask(rows, model.Asking(fast=None, context_allowed=False), cache)
    assert {r["context"]: r["lm_stats"] for r in none.collect()}["none2"] == ["full_skipped_no_input", "processed"]
    assert model.stats_counters(out).where("lm_outcome = 'processed'").first()["n"] == 7


def test_providers(spark):
    sent = []

    def post(body):
        sent.append(body)
        return (400, "") if "response_format" in body else (200, "no" if len(sent) < 3 else '{"title": "T"}')

    ask = model.chat_provider(post, "m", "system")
    assert ask(["q"]) == ['{"title": "T"}'] and [("response_format" in b, len(b["messages"])) for b in sent] == [(True, 2), (False, 2), (True, 4), (False, 4)]
    assert model.chat_provider(lambda b: (500, ""), "m", "s")(["q"]) == [None]
    one, two = lambda rs: [enrich.RATE_LIMITED if r == "l" else None for r in rs], lambda rs: ["2" if r == "b" else None for r in rs]
    assert enrich.first_of(one, two)(["a", "b", "l"]) == [None, "2", enrich.RATE_LIMITED]
    now, slept = [0.0], []
    paced = enrich.paced(lambda rs: rs, 10, lambda: now[0], lambda t: (slept.append(t), now.__setitem__(0, now[0] + t)))
    assert paced(["a", "b", "c"]) == ["a", "b", "c"] and slept == [10, 10]
    cache = spark.createDataFrame([], "cache_key string, payload_json string")
    out, fresh = enrich.lookup(spark.createDataFrame([("a",), ("l",)], "q string"), "q", "k", enrich.first_of(one), cache)
    assert fresh.count() == 1 and out.where("answer_json is null").count() == 2
    names = spark.createDataFrame([("Dune", "Herbert"), ("Дюна", "Герберт")], "title string, author string")
    told, asked = model.translate_names(names, lambda rs: ['{"title": "Дюна", "author": ""}' for _ in rs], cache, "ru")
    assert {tuple(r) for r in told.collect()} == {("Дюна", "Herbert"), ("Дюна", "Герберт")} and asked.count() == 1
    row = spark.createDataFrame([("T", "Unknown", "")], "title string, author string, genre string").select(model.brief("title", "author", "genre").alias("b")).first()
    assert row["b"] == '{"title":"T"}'


def test_index_refresh(spark):
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path_key string, size_bytes long, mtime_ns long")
    index = spark.createDataFrame([("a", 1, 1, "ha", "ok", ""), ("b", 9, 2, "hb", "ok", ""), ("z", 1, 1, "hz", "ok", "")], "path_key string, size_bytes long, mtime_ns long, xxh64 string, status string, note string")
    hashed = spark.createDataFrame([("b", "nb", ""), ("c", None, "bad_zip")], "path_key string, xxh64 string, note string")
    assert {r["path_key"]: r["change"] for r in index_sync.changes(listing, index).collect()} == {"a": "cached", "b": "pending", "c": "pending"}
    got = {r["path_key"]: (r["xxh64"], r["status"], r["note"]) for r in index_sync.refreshed(listing, index, hashed).collect()}
    assert got == {"a": ("ha", "ok", ""), "b": ("nb", "ok", ""), "c": (None, "failed", "bad_zip")}
    assert [r["path_key"] for r in index_sync.stale(index, listing).collect()] == ["z"]
    merged = index_sync.merged(index, index.where("path_key = 'a'").withColumn("note", F.lit("new")), "path_key", index.where("path_key = 'z'"))
    assert {r["path_key"]: r["note"] for r in merged.collect()} == {"a": "new", "b": ""}


def test_metadata_assembly(spark):
    rows = spark.createDataFrame([("/l/Frank Herbert - Dune.epub", [], ("T", "A", "poetry")), ("/l/Кулинария/665224.txt", ["Ivan - Soup.zip"], ("", "", "")), ("/l/history of x.txt", [], None)], "path string, archive_chain array<string>, tags struct<title:string,author:string,genre:string>")
    got = [tuple(r[c] for c in ("title", "author", "genre", "source", "confidence")) for r in M.assemble(rows).orderBy("path").collect()]
    want = [("Dune", "Frank Herbert", "Поэзия", "tags", 0.75), ("history of x", "Unknown Author", "История", "filename", 0.5), ("665224", "Unknown Author", "Кулинария", "filename", 0.5)]
    assert sorted(got) == sorted(want)
    assert M.assemble(rows, prefer_tags=True).where("title = 'T'").count() == 1
    best = rows.select(M.best_title(F.lit(""), F.col("path"), F.col("archive_chain")).alias("t"), M.best_author(F.lit(""), F.col("path"), F.col("archive_chain")).alias("a")).collect()
    assert ("Soup", "Ivan") in {tuple(r) for r in best} and ("Dune", "Frank Herbert") in {tuple(r) for r in best}


def test_lookup_calls_once_and_caches(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider(requests):
        with open(log, "a") as f:
            f.writelines(f"{r}\n" for r in requests)
        return ['{"title": "T", "subtitle": "S", "authors": [{"name": "A"}, {"name": "B"}], "subjects": [{"name": "poetry"}]}' if r == "1" else None for r in requests]

    cache = spark.createDataFrame([], "cache_key string, payload_json string")
    rows = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "isbn string")
    out, fresh = enrich.lookup(rows, "isbn", "isbn", provider, cache, parallel=1)
    assert out.count() == 4 and fresh.count() == 2 and sorted(open(log).read().split()) == ["1", "2"]
    again, none = enrich.lookup(rows, "isbn", "isbn", provider, fresh)
    assert none.count() == 0 and again.where("answer_json is not null").count() == 2
    book = again.where("isbn = '1'").select(enrich.open_library(F.col("answer_json")).alias("b")).first()["b"]
    assert tuple(book) == ("T: S", "A, B", "Поэзия")
    assert [enrich.backoff_seconds(n) for n in (1, 2, 3, 4, 5)] == [60, 120, 240, 480, 480]
    merged = enrich.merge_isbn(spark.createDataFrame([("Unknown", "", "Unknown", 0.3, "none", ("T", "A", "Поэзия"))], "title string, author string, genre string, confidence double, source string, f struct<title:string,author:string,genre:string>"), "f", F.lit("9780306406157")).first()
    assert (merged["title"], merged["author"], merged["genre"], merged["confidence"], merged["source"], merged["isbn"]) == ("T", "A", "Поэзия", 0.9, "isbn", "9780306406157")


def test_pack_and_verify(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/lib/a.zip", "a.txt", b"hello"), (f"{tmp_path}/lib/b.zip", "b.txt", b"")], "dest string, member string, content binary")
    packed = spark.createDataFrame(state.pack(rows).collect(), "dest string, status string, sha256 string")
    assert {r["status"] for r in packed.collect()} == {"packed"}
    assert zipfile.ZipFile(f"{tmp_path}/lib/a.zip").read("a.txt") == b"hello"
    assert state.verified(packed, rows, str(tmp_path / "lib")).where("delete_eligible").count() == 2
    assert state.verified(packed, rows, "/elsewhere").where("delete_eligible").count() == 0
    assert {r["status"] for r in state.pack(rows).collect()} == {"exists"}


def test_archive_rollup_and_book_counters(spark):
    rows = spark.createDataFrame([("a", True, "packed", 1), ("a", False, "nobook", 1), ("b", False, "nobook", 1), ("c", True, None, 1), (None, True, "packed", 1)], "archive_source string, is_book boolean, result string, size_bytes long")
    assert {r["archive_source"]: r["action"] for r in metrics.archive_rollup(rows).collect()} == {"a": "delete_eligible", "b": "move_nobook", "c": "wait"}
    total = metrics.book_counters(rows.withColumn("path", F.lit("/x/a.epub"))).first()
    assert tuple(total) == (5, 3, 2, 5, 4)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{k % 7}", k) for k in range(40)], "xxh64 string, n long")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    state.write_snapshot(spark.createDataFrame([("h0", "z")], "xxh64 string, canonical_zip string"), str(tmp_path / "known"))
    stream = jobs.arriving(spark, str(tmp_path / "in"), "xxh64 string, n long", 1)
    jobs.run_unique(stream, "xxh64", str(tmp_path / "known"), "xxh64 string, canonical_zip string", lambda b, k: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["xxh64"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"h{k}" for k in range(1, 7)]


def test_log_routes(spark, tmp_path):
    (tmp_path / "x.log").write_text("12 A7 route dest=/t/Наука/H/Herbert/Dune.2024.zip\nother line\n")
    routes = files.log_routes(spark, str(tmp_path / "x.log"))
    assert tuple(routes.first()) == ("Наука", "H", "Herbert", "Dune.2024")
    assert tuple(metrics.title_quality(routes).first()) == (1, 0, 0, 1)
    assert state.source_key(["/b/", "/a"]) == state.source_key(["/a", "/b"])


def test_text_is_cleaned_once_for_all_signals(spark):
    rows = spark.createDataFrame([("/t/a.txt", "<b>x</b> see the CHAPTER"), ("/t/b.txt", "y" * 1200 + " isbn"), ("/t/c.txt", None)], "path string, text string")
    out = rows.select(classify.verdict(F.col("path"), F.lit(10), F.col("text"), F.lit(False), F.lit(False), F.lit(""))["reason"].alias("reason"))
    assert [r["reason"] for r in out.collect()] == ["text_book_signals", "text_no_book_signals", "text_no_book_signals"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(text") <= 2
