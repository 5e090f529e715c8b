import json
import random
import time




from quire.operators import enrich, model
from quire.plans import catalogue
from quire.sources import buckets

CACHE = "cache_key string, payload_json string"


def test_slots_of_four_tasks_keep_one_rate():
    """A simulated clock: tasks of different speed, late starts and runs begun again."""
    r = random.Random(3)
    calls = []
    for task in range(4):
        now = r.uniform(0, 30)
        for _attempt in range(3):
            slots = enrich.Slots(task, 4, 100.0, 10.0)
            for _ in range(25):
                now = max(now, slots.next(now))
                calls.append(now)
                now += r.choice([0.0, 0.5, 9.0, 47.0])
            now += r.uniform(0.1, 5)
    calls.sort()
    assert min(b - a for a, b in zip(calls, calls[1:], strict=False)) >= 10 - 1e-6
    busy = enrich.Slots(2, 4, 0.0, 1.0)
    assert [busy.next(0.0) for _ in range(3)] == [2.0, 6.0, 10.0] and busy.next(25.0) == 26.0


def test_lookups_of_parallel_tasks_share_a_rate(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider(requests):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return [f'{{"q": "{q}"}}' for q in requests]

    rows = spark.createDataFrame([(str(k),) for k in range(12)], "q string")
    out, fresh = enrich.lookup(rows, "q", "k", provider, spark.createDataFrame([], CACHE), parallel=4, every=0.3)
    assert fresh.count() == 12 and out.where("answer_json is null").count() == 0
    at = sorted(map(float, open(log)))
    assert len(at) == 12 and min(b - a for a, b in zip(at, at[1:], strict=False)) >= 0.2


def test_rounds_ask_only_who_wants_more(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider(requests):
        with open(log, "a") as f:
            f.writelines(q + "\n" for q in requests)
        out = []
        for q in requests:
            pieces = json.loads(q)
            kind, n = pieces[0], len(pieces)
            answer = {"title": f"{kind}{n}", "genre": "poetry", "confidence": 1.0, "need_more_text": True}
            if kind == "soon":
                answer["need_more_text"] = n < 2
            if kind == "sure":
                answer["confidence"] = 5.0 if n == 3 else 2.0
            out.append("no object" if kind == "dumb" or (kind == "odd" and n == 2) else None if kind == "mute" else json.dumps(answer))
        return out

    kinds = {"soon": 5, "sure": 5, "long": 3, "dumb": 2, "mute": 2, "odd": 2, "none": 0}
    rows = spark.createDataFrame([(k, [k] + [f"p{j}" for j in range(1, n)] if n else []) for k, n in kinds.items()] + [("soon", ["soon", "p1", "p2", "p3", "p4"]), (None, ["x"])], "k string, pieces array<string>")
    answers, fresh = model.ask_rounds(rows, "k", "pieces", provider, spark.createDataFrame([], CACHE), most=4)
    got = {r["k"]: (json.loads(r["answer_json"])["title"], r["rounds"]) for r in answers.collect()}
    assert got == {"soon": ("soon2", 2), "sure": ("sure3", 3), "long": ("long3", 3), "odd": ("odd1", 2)}
    asked = [json.loads(line) for line in open(log)]
    assert len(asked) == fresh.count() == 2 + 3 + 3 + 2 + 2 + 2
    # a run that begins again asks nothing that was answered
    again, more = model.ask_rounds(rows, "k", "pieces", provider, fresh, most=4)
    assert more.count() == 0 and {r["k"]: r["rounds"] for r in again.collect()} == {k: v[1] for k, v in got.items()}
    none, _ = model.ask_rounds(rows.limit(0), "k", "pieces", provider, fresh)
    assert none.count() == 0


def test_rounds_in_the_model_flow(spark):
    data = [("a", "full", ["t1", "t2"]), ("b", "full", []), ("c", "skip:tags_confident", ["t1", "t2"])]
    rows = spark.createDataFrame([(c, "", d, p, "Old", "A", "Unknown", 0.3, "filename") for c, d, p in data], "context string, snippet string, lm_decision string, pieces array<string>, title string, author string, genre string, confidence double, source string")
    talk = lambda requests: ['{"title": "Found", "genre": "poetry", "confidence": %d}' % (5 if len(json.loads(q)) > 1 else 1) for q in requests]
    out, fresh = model.ask(rows, model.Asking(fast=None, rounds=talk), spark.createDataFrame([], CACHE))
    got = {r["context"]: (r["title"], r["source"], r["lm_stats"]) for r in out.collect()}
    assert got["a"] == ("Found", "model", ["iter_request", "iter_ok", "processed"])
    assert got["b"] == ("Old", "filename", ["iter_request", "iter_no_result", "processed"]) and got["c"][2] == ["skipped", "processed"]
    assert fresh.count() == 2


ISBN = "title string, author string, genre string, confidence double, source string, isbn_candidates array<string>, k int"


def test_isbn_providers_in_order(spark):
    rows = spark.createDataFrame([("", "", "Unknown", 0.3, "filename", ["9780306406157", "0306406152"], 1), ("", "", "Unknown", 0.3, "filename", ["x1", "0306406152"], 2), ("Known", "Author", "Unknown", 0.3, "filename", ["9780306406157"], 3), ("", "", "Unknown", 0.3, "filename", ["x1"], 4), ("", "", "Unknown", 0.3, "filename", [], 5)], ISBN)
    asked = spark.sparkContext.accumulator(0)

    def one(requests):
        asked.add(len(requests))
        return ['{"title": "One", "authors": [{"name": "A"}]}' if q == "9780306406157" else None for q in requests]

    two = lambda requests: ['{"items": [{"volumeInfo": {"title": "Two", "authors": ["B"], "categories": ["poetry"]}}]}' if q == "0306406152" else None for q in requests]
    providers = [("openlibrary", one, enrich.open_library), ("googlebooks", two, enrich.google_books)]
    out, fresh = enrich.ask_isbn(rows, ["k"], "isbn_candidates", providers, spark.createDataFrame([], CACHE))
    got = {r["k"]: (r["title"], r["author"], r["source"], r["isbn"]) for r in out.collect()}
    assert got == {1: ("One", "A", "isbn", "9780306406157"), 2: ("Two", "B", "isbn", "0306406152"), 3: ("Known", "Author", "filename", ""), 4: ("", "", "filename", ""), 5: ("", "", "filename", "")}
    # x1 and 978... in the first round, 0306406152 in the second: each once
    assert asked.value == 3 and fresh.count() == 5
    none, _ = enrich.ask_isbn(rows.where("k = 5"), ["k"], "isbn_candidates", providers, fresh)
    assert none.first()["isbn"] == ""


def test_run_asks_models_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "665224.txt").write_text("A chapter about nothing in particular, isbn and publisher. " * 20)

    def full(requests):
        with open(log, "a") as f:
            f.writelines("call\n" for _ in requests)
        return ['{"title": "Nothing", "author": "Some One", "genre": "poetry", "confidence": 5}' for _ in requests]

    config = catalogue.Config(target="/lib", asking=model.Asking(fast=None, full=full))
    rows = catalogue.run(spark, [str(tmp_path / "in")], str(tmp_path / "state"), config).collect()
    assert [(r["status"], r["dest"], r["source"], r["lm_stats"]) for r in rows] == [("packed", "/lib/Поэзия/S/Some One/Nothing.zip", "model", ["full_request", "full_ok", "processed"])]
    assert open(log).read().split() == ["call"] and buckets.read(spark, str(tmp_path / "state" / "answers"), CACHE).count() == 1
