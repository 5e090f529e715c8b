import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import DOCS, base_spans, by_id, documents, nothing, rows, sha

from quire.llm import byte_bpe, mixing, pii, quality, sharding, toxicity
from quire.llm.labels import held_out

RANKS = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks(spark):
    return byte_bpe.load_ranks(spark, public_tokenizers.path(RANKS))


def test_bpe_equals_the_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.tokenize(documents(spark), ranks, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    want = {}
    for doc_id, text, *_ in rows():
        ids = library.encode_ordinary(text or "")
        want.setdefault(doc_id, []).append((len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or "")))
    assert got == {k: sorted(v, key=str) for k, v in want.items()}
    assert byte_bpe.tokenize(nothing(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_odd_texts(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b", "a \n b", "<|endoftext|>", "日本 語", "a" * 1500, " " * 700, "é" * 600, "it's  we'll\t\n x"]
    texts += ["".join(rng.choice("ab ' é1\n日") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += ["".join(rng.choice("etaoin") for _ in range(rng.randint(300, 900))) for _ in range(5)]
    codec = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    for text, ids in zip(texts, codec.encode_bytes(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode_bytes(ids).decode() == text


def test_bpe_small_vocabulary_leftmost_least_rank():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aab": 259}
    codec = byte_bpe.ByteBpe(ranks, r"\S+")
    decoded = [np.frombuffer(x, "<u4").tolist() for x in codec.encode_bytes(["aaabc", "bcbc", "abcab"])]
    assert decoded == [[97, 97, 258], [257, 257], [258, 256]]


def test_sharding_laws(spark):
    docs = documents(spark, [(k, f"text {k} " * (50 + k % 13), "en", "a", 1) for k in range(200, 700)])
    found = sharding.assign(docs, n_old=3, n_new=4, cells=64).collect()
    total, sizes = sum(r["size"] for r in found), [0] * 4
    slots = [[] for _ in range(4)]
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 0.02 * total
    by_text = {(r["doc_id"], r["text_crc32"]): r["size"] for r in found}
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        assert by_text[doc_id, zlib.crc32(raw)] == len(raw) + 1
    again = {(r["doc_id"], r["text_crc32"], r["slot"]) for r in sharding.assign(docs, n_old=3, n_new=4, cells=64).collect()}
    assert len(found) == docs.count() and again == {(r["doc_id"], r["text_crc32"], r["slot"]) for r in found}
    assert sharding.assign(nothing(spark), 3, 4).count() == 0


def test_equal_texts_stay_together_unless_hot(spark):
    docs = documents(spark, [(k, f"pair {k // 2} " * 20, "en", "a", 1) for k in range(300, 900)] + [(k, "hot text " * 30, "en", "a", 1) for k in range(1000, 1600)])
    shards, sizes = {}, [0] * 4
    for r in sharding.assign(docs, 3, 4, cells=64).collect():
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
    hot = zlib.crc32(b"hot text " * 30)
    assert len(shards[hot]) > 1 and max(sizes) < 1.1 * min(sizes)
    assert sum(len(s) > 1 for k, s in shards.items()) < 0.1 * len(shards)


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(30):
        old = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        n = rng.randint(1, 6)
        caps = [rng.randint(0, 60) for _ in range(n)]
        caps[0] += max(0, sum(old) - sum(caps))
        flow = sharding.solve_transfers(old, caps)
        assert [sum(r) for r in flow] == old
        assert all(sum(r[j] for r in flow) <= caps[j] for j in range(n))
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        assert moved == sum(max(0, s - (caps[i] if i < n else 0)) for i, s in enumerate(old))
    with pytest.raises(ValueError, match="capacities"):
        sharding.solve_transfers([5], [4])


def test_reshard_of_a_real_layout(spark, tmp_path):
    """Old shards 0 (too full), 1 (fits), 2 (too empty) and rows of no shard: little moves, 1 stays."""
    at = lambda k: 0 if k < 500 else 1 if k < 800 else 2 if k < 900 else None
    data = [(k, f"text {k:04d} " * 10, at(k), 7) for k in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, home int, cell long")
    plain = sharding.solve_transfers([500, 300, 100, 100], [334, 333, 333], loose=3)
    assert sum(plain[i][j] for i in range(3) for j in range(3) if i != j) == 166
    found = {r["doc_id"]: r for r in sharding.assign(docs, 3, 3, old_col="home").collect()}
    size = len("text 0000 " * 10) + 1
    moved = sum(r["size"] for k, r in found.items() if at(k) is not None and r["shard"] != at(k))
    assert 166 * size <= moved <= 180 * size
    assert all(r["size"] == size for r in found.values()) and len(found) == 1000
    shares = [0.0] * 3
    for r in found.values():
        shares[r["shard"]] += r["size"] / (1000 * size)
    assert max(shares) - min(shares) < 0.02
    affected = sharding.reshard_files(docs, str(tmp_path / "new"), 3, 3, old_col="home", weights=[500, 300, 200])
    assert affected == {0: False, 1: False, 2: True}
    written = spark.read.parquet(str(tmp_path / "new")).collect()
    assert sorted(r["doc_id"] for r in written) == list(range(800, 1000)) and {r["shard"] for r in written} == {2}
    assert set(written[0].asDict()) == {"doc_id", "text", "cell", "shard"}


def test_resharding_moves_no_text_to_find_its_shard(spark):
    docs = documents(spark, [(k, f"hot text {k % 2} " * 60, "en", "a", 1) for k in range(300, 700)])
    moved, affected = sharding.rewritten(docs, 2, 3, cells=32)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "ENSURE_REQUIREMENTS" not in line]
    assert "SortMergeJoin" not in plan and not shuffles and plan.count("BroadcastHashJoin") == 2
    want = {(r["doc_id"], r["shard"]) for r in sharding.assign(docs, 2, 3, cells=32).collect() if affected[r["shard"]]}
    assert {(r["doc_id"], r["shard"]) for r in moved.collect()} == want


def test_reshard_files_writes_what_changed(spark, tmp_path):
    docs = documents(spark)
    affected = sharding.reshard_files(docs, str(tmp_path / "out"), 2, 3, cells=32)
    assert affected[2]
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == sum(1 for r in sharding.assign(docs, 2, 3, cells=32).collect() if affected[r["shard"]])
    assert set(docs.columns) < set(written.columns)


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, None: 5, "d": 0}
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    assert {s: pytest.approx(t) for s, t in target.items()} == {s: r["target"] for s, r in got.items()}
    assert {s: r["weight"] for s, r in got.items()} == weight


def _mixed(spark):
    rng = random.Random(6)
    docs = documents(spark, [(1000 + k, "word " * rng.randint(1, 60), "en", "abcde"[min(4, k % 9)], 1) for k in range(900)])
    return docs.where("doc_id is null or doc_id <> 9")  # equal rows that no share can split


def test_mix_meets_targets(spark):
    docs = _mixed(spark)
    share, _ = mixing.shares(docs)
    goals = {r["source"]: r for r in share.collect()}
    rows_ = mixing._copies(mixing._rows(docs, "doc_id", "text", "source", 7), share).collect()
    taken = {}
    for r in rows_:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, g in goals.items():
        if g["source_size"] > 2000:
            assert abs(taken[s] - g["target"]) <= 0.03 * g["source_size"] + 60
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows_)
    assert mixing.mix(docs).columns == docs.columns
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(nothing(spark)).count() == 0


def test_splitting_tree_deals_disjoint_even_shares(spark):
    docs = _mixed(spark)
    share, blocks = mixing.shares(docs)
    tree = mixing.splitting_tree(share, blocks, 2).collect()
    dealt = [s for r in tree for s in r["shards"]]
    counts = [dealt.count(k) for k in range(4)]
    assert max(counts) - min(counts) <= 2
    placed = mixing.mix(docs, levels=2, placed=True)
    assert placed.count() == mixing.mix(docs).count() and placed.columns == [*docs.columns, "shard"]


def labelled(spark):
    rng = random.Random(9)
    data, labels = [], []
    for k in range(900):
        words = ["".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        toxic, good = k % 5 == 0, k % 4 != 0
        if toxic:
            for w in ("grumbot", "vilezzo"):
                words.insert(rng.randint(0, len(words)), w)
        if k % 9 == 1:  # the benign phrase holds a bad word
            words += ["tin", "grumbot", "museum"]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        data.append((k, text, "en", "a", 1))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(found, labels, label):
    want = {r["doc_id"]: r[label] for r in labels.collect()}
    tested = [r for r in found.collect() if r["held_out"]]
    assert len(tested) > 100 and all(0 <= r["score"] <= 1 for r in tested)
    return np.mean([r["predicted"] == want[r["doc_id"]] for r in tested])


def test_quality_on_rows_held_out(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    assert accuracy(quality.score(docs, model), labels, "quality") > 0.97
    out = quality.keep_good(docs.withColumnRenamed("lang", "score"), model)
    assert out.columns[2] == "score" and 600 < out.count() < 750
    odd = quality.score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score(nothing(spark), model).count() == 0
    empty = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(documents(spark), empty).collect()} == {0.5}


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, n_pairs=2)
    assert ((model.score(x) > 0.5) == y).mean() > 0.93
    assert model.pairs[0][:2] == (0, 1)


def test_toxicity_on_rows_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic") > 0.97
    assert any("grumbot" in w for w in model.weights)
    assert any("museum" in p or "tin" in p for p in model.exceptions)
    odd = toxicity.score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(nothing(spark), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(documents(spark), none).collect()} == {0}


def test_toxicity_keeps_every_exception(spark):
    name = lambda k: "".join("bcdfghjk"[k >> 3 * i & 7] for i in range(4))
    benign = " ".join(f"{name(2 * k)} villain {name(2 * k + 1)}" for k in range(700))
    data = [(k, benign if k < 30 else f"q{k} villain" if k % 2 else f"calm {k}", "en", "a", 1) for k in range(430)]
    labels = [(k, 1, int(k >= 30 and k % 2)) for k in range(430)]
    model = toxicity.train(spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert " villain " in model.weights
    assert {f" {name(2 * k)} villain " for k in range(700)} | {f" villain {name(2 * k + 1)} " for k in range(700)} <= set(model.exceptions)


def test_toxicity_folds_and_spares():
    model = toxicity.ToxicModel({" idiot ": 3.0, " idio": 1.0}, [" no idiot "])
    found = model.automaton()
    total = lambda t: sum(toxicity.hits(found, toxicity.fold(t)).values())
    assert toxicity.fold("1D10T, іdiot!") == " idiot idiot "
    assert total("an IDIOT") == 3.0 and total("an 1d10t.") == 3.0 and total("іdіоt") == 3.0
    assert total("there is no idiot here") == 0.0 and total("no idiot and an idiot") == 3.0
    assert total("idiotic") == 1.0 and total("") == total(None) == 0.0


def test_held_out_rows(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out("id").alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(50)}


PII = [
    "a@b.c_d@e.f, x.y+z@mail.example.co.uk. @no dot@none user@host",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.001.000.255 1.2.3 9999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111x 1234 5678 " + "7" * 60,
    "+1 (555) 123-4567 +123 +12345678 +1234567890123456 ++49 30 1234567",
    "é ü bob@example.com 日本 10.0.0.1",
    "mail " * 20_000 + "z@z.zz",
    "a" * 50_000 + " " + "1" * 50_000 + "@",
]


def test_pii_base_against_plain(spark):
    data = [(k, t, "en", "a", 1) for k, t in enumerate(PII)]
    docs = documents(spark, [(5000 + i, *r) for i, *r in data])
    got = by_id(pii.extract(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = {}
    for doc_id, text, *_ in [*rows(), *((5000 + k, t) for k, t in enumerate(PII))]:
        found = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.setdefault(doc_id, []).append((*(sum(k == kind for k, *_ in found) for kind in pii.KINDS), sha(said)))
    assert got == {k: sorted(v, key=str) for k, v in want.items()}
    assert pii.extract(nothing(spark)).count() == 0


def test_pii_bootstraps_unseen_identifiers(spark):
    data = [(k, f"please dial +1 (555) 123-40{k:02d} for help", "en", "a", 1) for k in range(12)]
    data += [(100 + k, f"please dial 555-019{k} for help", "en", "a", 1) for k in range(8)]
    # values found there make a pattern of the next round, which finds what no seed stands beside
    data += [(110 + k, f"or ring up 555-019{k} by day", "en", "a", 1) for k in range(8)]
    data += [(120, "or ring up 555-0777 by day", "en", "a", 1)]
    data += [(200 + k, f"room 101{k} on floor {k}", "en", "a", 1) for k in range(9)]
    data += [(300 + k, f"the key AKIA{k}BCDEFGHIJKLMNOP was lost", "en", "a", 1) for k in range(8)]
    data += [(310, "the key AZZA1BCDEFGHIJKLMNO9 was lost", "en", "a", 1), (311, "a part Azza1BCDEFGHIJKLMNO8 was here", "en", "a", 1)]
    data += [(320, "TOKEN = \"00112233445566778899\" 0123", "en", "a", 1), (321, "token = 4111111111111112", "en", "a", 1)]
    found = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(data, DOCS)).collect()}
    assert all(found[100 + k]["spans"] == "phone:12:20" and found[100 + k]["n_phone"] == 0 for k in range(8))
    assert [found[d]["spans"] for d in (*range(110, 118), 120)] == ["phone:11:19"] * 9
    assert all(found[200 + k]["spans"] == "" for k in range(9))
    assert all(found[k]["n_added"] == 0 and found[k]["n_phone"] == 1 and found[k]["n_spans"] == 1 for k in range(12))
    assert all(found[300 + k]["spans"] == "secret:8:28" and found[300 + k]["n_induced"] == 0 for k in range(8))
    assert found[310]["spans"] == "secret:8:28" and found[310]["n_induced"] == 1 and found[311]["spans"] == ""
    assert found[320]["spans"] == "secret:9:29" and found[321]["spans"] == ""


def test_pii_patterns_find_what_other_texts_seed(spark):
    """Seeds of half the texts; patterns find the rest and nothing beside it."""
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    data = [(k, f'{word()} {word()} token = "{key()}" {word()} {word()}', "en", "a", 1) for k in range(60)]
    data += [(100 + k, f"{word()} version {k}.0 of {rng.randint(10**8, 10**9)} {word()}", "en", "a", 1) for k in range(20)]
    docs = spark.createDataFrame(data, DOCS)
    whole = {r["doc_id"]: r for r in pii.extract(docs).collect()}
    half = {r["doc_id"]: r for r in pii.extract(docs, seeded=0.5).collect()}
    assert {k: r["spans"] for k, r in half.items()} == {k: r["spans"] for k, r in whole.items()}
    assert sum(r["n_added"] for r in whole.values()) == 60 and not any(r["n_induced"] for r in whole.values())
    found = sum(r["n_induced"] for r in half.values())
    assert 15 <= found <= 45 and all(r["n_induced"] <= r["n_added"] for r in half.values())


def test_pii_runs_no_python(spark):
    plan = pii.extract(documents(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert hashlib.sha256(b"").hexdigest() in {r["base_sha256"] for r in pii.extract(documents(spark)).collect()}
