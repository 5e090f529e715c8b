import pytest
from helpers import DOCS, linked, normal, shingles

import corpus_pipeline
from quire.llm import byte_bpe, mixing, quality


def corpus(spark, tmp_path):
    import random

    rng = random.Random(3)
    data, labels = [], []
    for k in range(300):
        words = ["".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        good = k % 4 != 0
        data.append((k, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "en", "ab"[k % 2] if k % 5 else None, 1))
        labels.append((k, int(good), 0))
    for k in range(0, 60, 3):
        words = data[k][1].split()
        data.append((1000 + k, data[k][1].upper() if k % 4 == 0 else data[k][1], "en", "a", 1))
        data.append((2000 + k, " ".join(words[:-1] + ["zzz"]), "en", "b", 1))
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_against_plain_versions(spark, tmp_path):
    sf_dir = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "tokens"]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = docs.collect()
        assert name == "tokens" or docs.columns == columns

    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in quality.score(spark.createDataFrame(rows), model).collect()}
    assert {r["doc_id"] for r in at["quality"]} == {k for k, good in scores.items() if good}

    last = {}
    for r in at["quality"]:
        last[normal(r["text"])] = max(last.get(normal(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in at["exact_dedup"]) == sorted(last.values())

    left = sorted(at["exact_dedup"], key=lambda r: r["doc_id"])
    label = linked([shingles(r["text"], 5) for r in left], 80)
    least = {}
    for r, k in zip(left, label, strict=True):
        least.setdefault(k, r["doc_id"])
    assert sorted(r["doc_id"] for r in at["near_dedup"]) == sorted(least.values())
    assert len(at["near_dedup"]) < len(at["exact_dedup"]) < len(at["quality"]) < len(rows)

    share, _ = mixing.shares(spark.createDataFrame(at["near_dedup"], DOCS))
    for g in share.collect():
        taken = sum(len(r["text"].split()) for r in at["mixing"] if r["source"] == g["source"])
        assert taken == pytest.approx(g["target"], abs=60)
    assert len(at["tokens"]) == len(at["mixing"])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(at["tokens"])
    assert set(byte_bpe.tokenize.__annotations__) >= {"docs", "ranks", "pattern"}


def test_mix_is_dealt_and_shuffled(spark, tmp_path):
    docs = spark.read.parquet(f"{corpus(spark, tmp_path)}/documents.parquet")
    got = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    got, want, plain = ([r["doc_id"] for r in df.collect()] for df in (got, mixing.mix(docs, placed=True), mixing.mix(docs)))
    assert got == want and sorted(got) == sorted(plain)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
