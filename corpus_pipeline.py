"""A training-corpus pipeline: keep good texts, drop copies and near copies, mix, tokenise.

Each stage is written as Parquet and read again as the next one's documents, so a lost executor
costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from quire.llm.common import table, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on labelled rows of ``docs``; rejected documents go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; of each group the document with the least id stays."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, dealt to shards and shuffled within each."""
    return mixing.mix(docs, placed=True).drop("shard")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(spark, public_tokenizers.path(VOCABULARY))
    return byte_bpe.tokenize(docs, ranks, public_tokenizers.PATTERN, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_texts),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: A fitted model and iterated components are beyond SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
