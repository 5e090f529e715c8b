"""The whole run as one plan: scan, unpack, classify, deduplicate, describe, route.

Inputs are never moved or deleted: the result is a table of what should happen to each file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import content as B
from quire.functions import genre as G
from quire.functions import text as T
from quire.operators import classify, dedupe, enrich, model
from quire.operators import metadata as M
from quire.sources import archives, buckets, files, state

CACHE_SCHEMA = "cache_key string, payload_json string"
HASH_SCHEMA = "xxh64 string, canonical_zip string, title string, author string, genre string"


@dataclass(frozen=True)
class Config:
    target: str = "/library"
    duplicates: str = "/library/Duplicates"
    nobook: str = "/library/NoBook"
    errors: str = "/library/Error"
    language: str = "ru"
    snippet_chars: int = 1800
    prefer_tags: bool = False
    force_full: bool = False
    limits: dict[str, int] = field(default_factory=dict)
    #: Bytes of files to a task; without it a task has one of the folders right below a root.
    task_bytes: int | None = None
    #: Providers of ISBN answers, in order of trust: (name, provider, reader of its answers).
    isbn: tuple[tuple[str, enrich.Provider, Callable[[Column], Column]], ...] = ()
    #: Seconds between two ISBN calls of the whole cluster.
    isbn_every: float | None = 10.0
    #: Who is asked about books that names, tags and ISBN leave open.
    asking: model.Asking | None = None
    piece_chars: int = 3000
    most_pieces: int = 8


def describe(books: DataFrame, config: Config) -> DataFrame:
    """Metadata, ISBN candidates and the enrichment decision of unique books."""
    rows = books.withColumn("tags", B.tags(F.col("content"), F.col("path"))).withColumn("snippet", B.snippet(F.col("content"), F.col("path"), config.snippet_chars))
    rows = M.assemble(rows, config.prefer_tags)
    rows = rows.withColumn("isbn_candidates", M.isbn_candidates(F.col("path"), [F.col("title"), F.col("author"), F.col("genre")], F.col("snippet")))
    decided = M.decision(F.col("title"), F.col("author"), F.col("genre"), F.col("source"), F.col("confidence"), config.force_full)
    return rows.withColumn("lm_decision", decided).withColumn("lm_route", enrich.route(F.col("lm_decision"), F.col("snippet")))


def enriched(told: DataFrame, config: Config, cache: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Described books with what ISBN providers and models say, and the new answers for the cache.

    The decision whether a model is asked is made again after ISBN answers. A book without an answer
    goes on unchanged.
    """
    news = []
    if config.isbn:
        told, fresh = enrich.ask_isbn(told, ["path", "archive_chain"], "isbn_candidates", list(config.isbn), cache, config.isbn_every)
        decided = M.decision(F.col("title"), F.col("author"), F.col("genre"), F.col("source"), F.col("confidence"), config.force_full)
        told = told.withColumn("lm_decision", decided).withColumn("lm_route", enrich.route(F.col("lm_decision"), F.col("snippet")))
        news.append(fresh)
    else:
        told = told.withColumn("isbn", F.lit(""))
    if config.asking:
        told = told.withColumn("context", T.fallback_context(F.col("path"), F.col("archive_chain"))).withColumn("pieces", T.text_chunks(F.col("text"), config.piece_chars, config.most_pieces))
        told, fresh = model.ask(told, config.asking, cache)
        told = told.drop("context", "pieces")
        news.append(fresh)
    else:
        told = told.withColumn("lm_stats", F.array().cast("array<string>"))
    out = None
    for fresh in news:
        out = fresh if out is None else out.unionByName(fresh)
    return told, out


def actions(roots: list[str], spark: SparkSession, config: Config, known: DataFrame | None = None, state_dir: str | None = None) -> DataFrame:
    """One row per file: path, status, reason, metadata and where it belongs.

    Answers from outside are kept in ``state_dir``/answers, as soon as they are there.

    Cheap steps come first: files that are no books or are copies are settled before tags are read.
    What a stage decides is written before the next one reads it, so nothing is unpacked, decoded or
    hashed again, and no plan holds the expressions of two stages. Contents are kept of books only.
    """
    found = archives.with_members(files.scan(spark, roots) if config.task_bytes is None else files.balanced_scan(spark, roots, task_bytes=config.task_bytes), **config.limits)
    base = F.coalesce(*(F.when(T.is_under(F.col("path"), F.lit(r.rstrip("/"))), F.lit(r.rstrip("/"))) for r in roots), F.lit(""))
    judged = classify.classify(found.withColumn("source_root", base)).withColumn("content", F.when(F.col("is_book"), F.col("content")))
    judged = state.settled(judged.withColumn("xxh64", F.when(F.col("content").isNotNull(), B.xxh64(F.col("content")))), "judged")
    books = dedupe.claim(judged.where("is_book"), "xxh64", ["archive_chain", "path"], known)
    rest = judged.where("not is_book").select("path", "archive_chain", "archive_source", "size_bytes", F.when(F.col("note") != "", "failed").otherwise("nobook").alias("status"), F.when(F.col("note") != "", F.col("note")).otherwise(F.col("reason")).alias("reason"), F.when(F.col("note") != "", F.concat_ws("/", F.lit(config.errors), T.error_bucket(T.stem_of(F.col("path"))), T.name_of(F.col("path")))).otherwise(T.nobook_path(config.nobook, F.col("path"), F.col("source_root"), F.col("archive_chain"))).alias("dest"))
    copies = books.where("status = 'duplicate'").select("path", "archive_chain", "archive_source", "size_bytes", F.when(F.col("archive_source").isNull(), "duplicate").otherwise("duplicate_temp").alias("status"), "reason", "xxh64", T.duplicate_path(config.duplicates, F.col("xxh64"), F.col("path"), F.col("archive_source")).alias("dest"))
    told = describe(books.where("status = 'unique'"), config)
    if config.asking and (config.asking.rounds or config.asking.iterative):
        told = told.withColumn("text", B.snippet(F.col("content"), F.col("path"), config.piece_chars * config.most_pieces, True))
    else:
        told = told.withColumn("text", F.lit(""))
    told = state.settled(told.drop("content"), "described")
    answers = f"{state_dir}/answers"
    cache = buckets.read(spark, answers, CACHE_SCHEMA) if state_dir else spark.createDataFrame([], CACHE_SCHEMA)
    told, fresh = enriched(told, config, cache)
    if fresh is not None and state_dir:
        buckets.upsert(spark, answers, CACHE_SCHEMA, "cache_key", fresh.dropDuplicates(["cache_key"]))
    title, author = M.best_title(F.col("title"), F.col("path"), F.col("archive_chain")), M.best_author(F.col("author"), F.col("path"), F.col("archive_chain"))
    told = told.withColumn("__title", title).withColumn("__author", author).withColumn("title", T.clean_book_title(F.col("__title"), F.col("__author"))).withColumn("author", F.col("__author")).withColumn("genre", G.translated(F.col("genre"), config.language))
    told = told.withColumn("dest", T.destination_path(config.target, F.col("genre"), F.col("author"), F.col("title")))
    told = state.settled(told.drop("snippet", "tags", "text"), "destinations")
    told = dedupe.unique_names_by_hash(told, "dest", "xxh64", ["archive_chain", "path"], lambda name: F.regexp_replace(name, r"\.zip$", ""), lambda _: F.lit(".zip"), None if known is None else known.select("canonical"))
    packed = told.select("path", "archive_chain", "archive_source", "size_bytes", F.lit("packed").alias("status"), "reason", "xxh64", F.col("unique_dest").alias("dest"), "title", "author", "genre", "source", "confidence", "isbn_candidates", "isbn", "lm_decision", "lm_route", "lm_stats")
    return packed.unionByName(copies, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def run(spark: SparkSession, roots: list[str], state_dir: str, config: Config | None = None) -> DataFrame:
    """Compute the actions and publish the hashes of packed files for the next run."""
    config = config or Config()
    index = f"{state_dir}/hash_index"
    known = buckets.read(spark, index, HASH_SCHEMA)
    result = actions(roots, spark, config, known.withColumnRenamed("canonical_zip", "canonical"), state_dir)
    state.write_snapshot(result, f"{state_dir}/actions")
    result = state.read_snapshot(spark, f"{state_dir}/actions", result.schema)
    packed = result.where("status = 'packed'").select("xxh64", F.col("dest").alias("canonical_zip"), "title", "author", "genre")
    buckets.upsert(spark, index, HASH_SCHEMA, "xxh64", packed.where("xxh64 is not null"))
    return result
