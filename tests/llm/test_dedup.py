import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, by_id, documents, linked, normal, nothing, repeated_runs, rows, sha, shingles

from quire.llm import embedding_dedup, exact_dedup, ngram_join, repeats
from quire.llm.common import components


def test_exact_copies_against_plain(spark):
    want = {}
    for doc_id, text, *_ in rows():
        group = [i for i, t, *_ in rows() if normal(t) == normal(text)]
        ids = [i for i in group if i is not None]
        want.setdefault(doc_id, []).append((max(ids, default=None), len(group), sha(normal(text))))
    got = by_id(exact_dedup.find_copies(documents(spark)), "keep_id", "group_size", "text_sha256")
    assert got == {k: sorted(v, key=str) for k, v in want.items()}


def test_exact_copies_keep_one_each(spark):
    found = exact_dedup.find_copies(documents(spark)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(v) == 1 for v in groups.values())
    assert exact_dedup.find_copies(nothing(spark)).count() == 0


def test_drop_copies_keeps_columns_and_other_names(spark):
    docs = documents(spark).withColumnRenamed("lang", "keep_id").withColumnRenamed("source", "raw")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({normal(t) for _, t, *_ in rows()})
    assert out.where("doc_id = 9").count() == 1


def test_recipes_meet_again_after_an_insert():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 120, 60_000).astype(np.uint8)
    cuts = exact_dedup.cut_points(data)
    moved = exact_dedup.cut_points(np.concatenate((data[:100], [120], data[100:])).astype(np.uint8))
    assert len(set(cuts[cuts > 200] + 1) & set(moved)) == (cuts > 200).sum() > 10
    ends = exact_dedup.recipe_bounds(0, 60_000, cuts.tolist())
    assert ends[-1] == 60_000 and max(np.diff([0, *ends])) <= exact_dedup.MOST


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_against_all_pairs(spark, width, percent):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(40)]
    extra = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        for k in range(9):
            other = [w if rng.random() > 0.02 else rng.choice(words) for w in base]
            extra.append((1000 + family * 100 + k, " ".join(other), "en", "a", 1))
    all_rows = [r for r in [*rows(), *extra] if r[0] is not None and r[0] != 9]
    docs = spark.createDataFrame(all_rows, DOCS)
    sets = [shingles(t, width) for _, t, *_ in all_rows]
    label = linked(sets, percent)
    least = {}
    for (doc_id, *_), k in zip(all_rows, label, strict=True):
        least[k] = min(least.get(k, doc_id), doc_id)
    want = {r[0]: [(len(s), least[k])] for r, s, k in zip(all_rows, sets, label, strict=True)}
    assert by_id(ngram_join.link_texts(docs, width, percent, star=2), "n_shingles", "component_id") == want


def test_last_round_meets_each_pair_once(spark, monkeypatch):
    """A large group about the threshold: many texts, few of them linked through leaders."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    data = [(k, " ".join(w if rng.random() > 0.022 else f"x{k}_{i}" for i, w in enumerate(base)), "en", "a", 1) for k in range(90)]
    sets = [shingles(t, 5) for _, t, *_ in data]
    least = {}
    label = linked(sets, 80)
    for k, x in enumerate(label):
        least.setdefault(x, k)
    joined, plain = [], ngram_join._pairs

    def counted(rows):
        joined.append((rows.count(), plain(rows).count()))
        return plain(rows)

    monkeypatch.setattr(ngram_join, "_pairs", counted)
    got = by_id(ngram_join.link_texts(spark.createDataFrame(data, DOCS), 5, 80), "component_id")
    assert got == {k: [(least[x],)] for k, x in enumerate(label)} and 1 < len(least) < 90
    rows, pairs = joined[-1]
    assert 50 < pairs <= rows < 2 * pairs


def test_shingles_of_one_class_stay_where_they_are(spark):
    classes = spark.createDataFrame([(b"a", [5, 1 << 40, 7, 9]), (b"b", [7, 5, -3]), (b"c", [7, 11, 5]), (b"d", [])], "d binary, prefix array<long>")
    often = spark.createDataFrame([(5, 3), (7, 3), (-3, 2)], "h long, c long")
    got = {bytes(r["d"]): (list(r["pos"]), list(r["h"]), list(r["firsts"])) for r in ngram_join._thinned(classes, often, 2).collect()}
    assert got == {b"a": ([0, 2], [5, 7], [5, 7]), b"b": ([0, 1, 2], [7, 5, -3], [7, 5]), b"c": ([0, 2], [7, 5], [7, 5]), b"d": ([], [], [])}


def test_ngram_join_odd_rows(spark):
    got = by_id(ngram_join.link_texts(documents(spark)), "n_shingles", "component_id")
    assert got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[7] == [(1, 7)]
    assert got[2] == got[1] == [(12, 1)] and got[9] == [(1, 9), (1, 9)]
    assert sorted(got[None]) == [(0, None), (1, None)] or got[None] == [(0, None), (1, None)]
    assert ngram_join.link_texts(nothing(spark)).count() == 0


def test_keep_one_of_each_component(spark):
    docs = documents(spark)
    out = ngram_join.keep_one(docs, 3, 90)
    assert out.columns == docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert left.count(9) == 1 and 1 in left and 2 not in left and 3 in left and 4 in left


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate((a[: rng.integers(1, 300)], rng.integers(0, 1 << 63, 40).astype(np.uint64))))
        distance = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
        assert distance <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("span", [150, 400])
def test_repeats_against_plain(spark, span):
    texts = [(t or "").encode() for _, t, *_ in rows()]
    want = {}
    for (doc_id, *_), b, runs in zip(rows(), texts, repeated_runs(texts, span), strict=True):
        kept = b"".join(b[x:y] for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(b)], strict=True))
        want.setdefault(doc_id, []).append((len(b), sum(y - x for x, y in runs), len(runs), sha(kept)))
    got = by_id(repeats.find_repeats(documents(spark), span), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == {k: sorted(v, key=str) for k, v in want.items()}
    assert repeats.find_repeats(nothing(spark), span).count() == 0


@pytest.mark.parametrize("words", [51, 20])
def test_repeated_passages_by_words_against_plain(spark, words):
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
    shared = [fresh(n) for n in (55, 60, 50, 30, 110)]
    data = [(100 + k, f"{fresh(40)} {shared[k % 5]} {fresh(30 + k)}", "en", "a", 1) for k in range(20)]
    data += [(200, "x" + shared[0], "en", "a", 1), (201, "a " * 260, "en", "a", 1), (202, shared[1][:230] + "\n" + shared[1][:230], "en", "a", 1)]
    texts = [(t or "").encode() for _, t, *_ in rows() + data]

    def windows(body):
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", body)]
        pairs = [(x[0], y[1]) for x, y in zip(spans, spans[words - 1 :], strict=False)]
        return spans, [(x, y) for x, y in pairs if repeats.GRAM <= y - x < 400]

    seen = Counter(body[a:b] for body in texts for a, b in windows(body)[1])

    def told(body, removed):
        spans, own = windows(body)
        runs = repeats._merged(iter(sorted([tuple(r) for r in removed] + [(a, b) for a, b in own if seen[body[a:b]] > 1])))
        return sum(sum(a <= x and y <= b for x, y in spans) >= words for a, b in runs)

    want = {}
    for (doc_id, *_), body, removed in zip(rows() + data, texts, repeated_runs(texts, 400), strict=True):
        want.setdefault(doc_id, []).append((told(body, removed), sum(b - a for a, b in removed)))
    got = by_id(repeats.find_repeats(documents(spark, data), words=words), "n_passages", "n_removed")
    assert got == {k: sorted(v, key=str) for k, v in want.items()}
    assert 3 < sum(n > 0 for v in got.values() for n, _ in v) < len(texts)
    assert any(n and not gone for v in got.values() for n, gone in v)


def test_equal_pieces_of_a_hot_anchor(spark, monkeypatch):
    """Many copies of one passage, short and long, amid different texts and at the ends of texts."""
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(rng.randint(2, 5))) for _ in range(n))
    short, long = fresh(54), fresh(260)
    data = [(k, [f"{fresh(6)} {short} {fresh(7)}", short, f"{long} {fresh(3)}", f"{fresh(9)} {long}", f"x {long} {long}"][k % 5] + f" {k % 3}", "en", "a", 1) for k in range(40)]
    texts = [t.encode() for _, t, *_ in data]
    spans = lambda b: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    windows = lambda b: [(x[0], y[1]) for x, y in zip(spans(b), spans(b)[50:], strict=False) if y[1] - x[0] < 400]
    seen = Counter(b[x:y] for b in texts for x, y in windows(b))
    want = {}
    for k, (b, runs) in enumerate(zip(texts, repeated_runs(texts, 400), strict=True)):
        held = repeats._merged(iter(sorted([tuple(r) for r in runs] + [w for w in windows(b) if seen[b[slice(*w)]] > 1])))
        want[k] = [(sum(y - x for x, y in runs), len(runs), sum(sum(x <= s and e <= y for s, e in spans(b)) >= 51 for x, y in held))]
    got = by_id(repeats.find_repeats(spark.createDataFrame(data, DOCS)), "n_removed", "n_spans", "n_passages")
    assert got == want


def test_repeats_with_hot_anchor_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(450))
    data = [(k, "".join(rng.choice("ijklmnop ") for _ in range(300)) + shared[: 380 + 5 * k] + f" {k}", "en", "a", 1) for k in range(15)]
    runs = repeated_runs([t.encode() for _, t, *_ in data], 400)
    got = by_id(repeats.find_repeats(spark.createDataFrame(data, DOCS)), "n_removed", "n_spans")
    assert got == {k: [(sum(y - x for x, y in r), len(r))] for k, r in enumerate(runs)}


@pytest.mark.parametrize("block", [4000, 11_000])
def test_repeats_within_one_passage_of_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(5)
    data = [(k, "".join(rng.choice("abcdefgh ") for _ in range(150 + 5 * k)) * 20 + f" {k}", "en", "a", 1) for k in range(24)]
    runs = repeated_runs([t.encode() for _, t, *_ in data], 400)
    assert all(runs)
    got = by_id(repeats.find_repeats(spark.createDataFrame(data, DOCS)), "n_removed", "n_spans")
    assert got == {k: [(sum(y - x for x, y in r), len(r))] for k, r in enumerate(runs)}


def test_suffix_array_and_runs():
    rng = np.random.default_rng(0)
    parts = [rng.integers(1, 3, n) for n in (50, 1, 90, 30)]
    text = np.concatenate([np.append(p, 0) for p in parts + [parts[0]]]).astype(np.int16)
    # ends differ from each other by place
    plain = sorted(range(len(text)), key=lambda i: [(int(x), i + k if x == 0 else 0) for k, x in enumerate(text[i:])])
    order = repeats.suffix_array(text)
    lengths = [next(k for k, x in enumerate(text[i:]) if x == 0) for i in range(len(text))]
    cut = lambda i: tuple(text[i : i + lengths[i]])
    assert [cut(i) for i in order] == [cut(i) for i in plain]
    p, q = repeats.run_ends(text, order)
    for i, j, n in zip(p, q, repeats.match_lengths(text, p, q), strict=True):
        a, b = cut(i), cut(j)
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    data = []
    for k in range(240):
        data.append((k, (base[k % 40] + rng.normal(size=24) * (0.02 + 0.3 * (k % 7 == 0))).astype(np.float32).tolist()))
    data += [(900 + k, data[5][1]) for k in range(5)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None] * 12), (1004, [])]
    return data, spark.createDataFrame(data + odd + [(None, data[7][1])], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [1024, 4])
def test_embeddings_against_all_pairs(spark, block):
    data, df = vectors(spark)
    x = np.array([v for _, v in data] + [data[7][1]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(df, block=block, miss=1e-4).collect()}
    want = hit.sum(1)
    found = sum(got[i][0] for i, _ in data)
    assert all(got[i][0] <= n for (i, _), n in zip(data, want, strict=False))
    assert found >= 0.99 * want[:-1].sum()
    assert all(got[k] == (0, k, True) for k in range(1000, 1005))
    assert got[900][1] == got[5][1] <= 5 and not got[900][2]
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_embeddings_of_two_lengths(spark):
    rng = np.random.default_rng(8)
    data = []
    for d, first, n in ((24, 0, 60), (10, 100, 20)):
        base = rng.normal(size=(n // 2, d))
        data += [(first + k, (base[k % (n // 2)] * (1 + k) + rng.normal(size=d) * 0.02).tolist()) for k in range(n)]
    data.append((30, data[60 + 3][1]))  # one id with vectors of both lengths joins their components
    got = {}
    for r in embedding_dedup.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), miss=1e-4).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert all(got[100 + k] == [(1, 100 + k % 10)] for k in range(20) if k % 10 != 3)
    assert all(got[k] == [(1, k % 30)] for k in range(60) if k % 30)
    assert sorted(got[30]) == [(1, 0), (2, 0)] and got[103] == got[113] == [(2, 0)]


@pytest.mark.parametrize("n, dim, cosine", [(10**9, 64, 0.9), (10**9, 64, 0.5), (10**9, 512, 0.2)])
def test_tables_keep_the_stated_miss(n, dim, cosine):
    lsh = embedding_dedup.choose(n, dim, cosine, 0.005)
    rng = np.random.default_rng(21)
    a, b = np.linalg.qr(rng.normal(size=(3000, dim, 2)))[0].transpose(2, 0, 1)
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    one = embedding_dedup.CrossPolytope(dim, lsh.k, 1, lsh.probes)
    meet = (one.codes(a)[:, 0, :, None] == one.codes(b)[:, 0, None, :]).any(axis=(1, 2)).mean()
    assert (1 - meet) ** lsh.tables <= 0.01


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
