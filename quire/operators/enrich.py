"""Outside lookups: distinct keys, a cache, a provider in Arrow batches, and joining back.

A provider is any callable from a list of requests to a list of answers (JSON text or null). It is
called for keys that the cache lacks, once each; negative answers are kept too, but for those that
a provider refused for their rate.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import genre as G
from quire.functions import isbn as I
from quire.functions import text as T
from quire.sources.state import settled

Provider = Callable[[list[str]], list[str | None]]


#: An answer that is none and must not be kept: ask again another time.
RATE_LIMITED = "rate limited"


def first_of(*providers: Provider) -> Provider:
    """Providers in order of trust: the first that knows a request answers it."""

    def ask(requests: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(requests)
        for provider in providers:
            open_ = [k for k, a in enumerate(out) if a in (None, RATE_LIMITED)]
            for k, answer in zip(open_, provider([requests[k] for k in open_]) if open_ else [], strict=True):
                if answer is not None:
                    out[k] = answer
        return out

    return ask


def paced(provider: Provider, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """One request every ``seconds``: a slot is reserved, then waited for. For one task at a time."""
    free = [float("-inf")]

    def ask(requests: list[str]) -> list[str | None]:
        out = []
        for request in requests:
            now = clock()
            slot = max(now, free[0])
            free[0] = slot + seconds
            if slot > now:
                sleep(slot - now)
            out += provider([request])
        return out

    return ask


class Slots:
    """One call every ``seconds`` over all of ``tasks`` tasks, without a word between them.

    Time from ``begin`` on is cut into slots, dealt round to the tasks: task t owns slots t, t + tasks,
    and so on for ever. A call takes its task's next slot that has not begun, so calls of different
    tasks never share one, however late a task starts or how often it is run again.
    """

    def __init__(self, task: int, tasks: int, begin: float, seconds: float):
        self.task, self.tasks, self.begin, self.seconds = task, tasks, begin, seconds
        self.last = -1

    def next(self, now: float) -> float:
        """When the call may be made that is asked for at ``now``."""
        turn = math.ceil(((now - self.begin) / self.seconds - self.task) / self.tasks)
        self.last = max(turn, self.last + 1, 0)
        return self.begin + (self.task + self.last * self.tasks) * self.seconds

    def paced(self, provider: Provider, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Provider:
        """``provider`` with each request in a slot of its own."""

        def ask(requests: list[str]) -> list[str | None]:
            out = []
            for request in requests:
                at = self.next(clock())
                while (wait := at - clock()) > 0:
                    sleep(wait)
                out += provider([request])
            return out

        return ask


def stub_provider(requests: list[str]) -> list[str | None]:
    """Answers nothing; stands in where there is no network."""
    return [None] * len(requests)


def cache_key(kind: str, request: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), request.alias("request"))), 256)


def lookup(rows: DataFrame, request: str, kind: str, provider: Provider, cache: DataFrame, parallel: int | None = None, every: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``answer_json``, and the new cache rows (cache_key, payload_json).

    The provider runs here and now, and its answers are written before anything reads them, so it
    is called once for each key however often the results are used. ``parallel`` bounds how many
    calls run at a time; the steps before stay parallel. ``every`` seconds a call may be made by the
    whole cluster (see ``Slots``; clocks of its machines must agree, and no task run twice at a time).
    """
    keyed = rows.withColumn("cache_key", F.when(F.col(request).isNotNull(), cache_key(kind, F.col(request))))
    wanted = keyed.where("cache_key is not null").groupBy("cache_key").agg(F.first(request).alias("request")).join(cache, "cache_key", "left_anti")
    if every is not None:
        parallel = parallel or rows.sparkSession.sparkContext.defaultParallelism
    wanted = wanted if parallel is None else wanted.repartition(parallel, "cache_key")
    begin = time.time()

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider if every is None else Slots(TaskContext.get().partitionId(), parallel, begin, every).paced(provider)
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "payload_json": ask(batch["request"].tolist())})

    fresh = settled(wanted.mapInPandas(call, "cache_key string, payload_json string"), "answers")
    fresh = fresh.where(F.coalesce("payload_json", F.lit("")) != RATE_LIMITED)
    known = cache.select("cache_key", "payload_json").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("payload_json", "answer_json"), "cache_key", "left").drop("cache_key"), fresh


def backoff_seconds(n: int) -> int:
    return min(60 * 2 ** max(0, n - 1), 480)


def open_library(payload: Column) -> Column:
    """struct(title, author, genre) of an Open Library answer: title with subtitle, authors joined."""
    p = F.from_json(payload, "title string, subtitle string, authors array<struct<name:string>>, subjects array<struct<name:string>>")
    return _book(p["title"], p["subtitle"], p["authors"]["name"], p["subjects"]["name"])


def google_books(payload: Column) -> Column:
    p = F.get(F.from_json(payload, "items array<struct<volumeInfo:struct<title:string,subtitle:string,authors:array<string>,categories:array<string>>>>")["items"], F.lit(0))["volumeInfo"]
    return _book(p["title"], p["subtitle"], p["authors"], p["categories"])


def _book(title: Column, subtitle: Column, authors: Column, subjects: Column) -> Column:
    full = F.when(T.clean(subtitle) != "", F.concat(T.clean(title), F.lit(": "), T.clean(subtitle))).otherwise(T.clean(title))
    genres = F.filter(F.transform(F.slice(F.coalesce(subjects, F.array().cast("array<string>")), 1, 8), G.normalize), lambda g: g != "Unknown")
    found = F.struct(full.alias("title"), F.array_join(F.filter(F.transform(authors, T.clean), lambda a: a != ""), ", ").alias("author"), F.coalesce(F.get(genres, F.lit(0)), F.lit("")).alias("genre"))
    return F.when(T.text_of(title) != "", found)


def merge_isbn(rows: DataFrame, found: str, isbn: Column) -> DataFrame:
    """Fill title, author and genre that are missing from an ISBN answer."""
    from quire.operators import metadata as M

    f = {k: T.text_of(F.col(f"{found}.{k}")) for k in ("title", "author", "genre")}
    fill = {
        "title": F.when(M.missing_title(F.col("title")) & (f["title"] != ""), f["title"]).otherwise(F.col("title")),
        "author": F.when(M.missing_author(F.col("author")) & (f["author"] != ""), f["author"]).otherwise(F.col("author")),
        "genre": F.when(F.col("genre").isin("", "Unknown") & (f["genre"] != ""), f["genre"]).otherwise(F.col("genre")),
        "confidence": F.when(F.col(found).isNotNull(), F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")),
        "source": F.when(F.col(found).isNotNull(), "isbn").otherwise(F.col("source")),
    }
    return rows.select(*(fill[c].alias(c) if c in fill else F.col(c) for c in rows.columns), F.when(F.col(found).isNotNull(), I.normalize(isbn)).otherwise("").alias("isbn"))


def ask_isbn(rows: DataFrame, key: list[str], candidates: str, providers: list[tuple[str, Provider, Callable[[Column], Column]]], cache: DataFrame, every: float | None = None, parallel: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with what ISBN providers know merged in (``merge_isbn``), and the new cache rows.

    Only rows whose title or author is missing are asked about. Candidates are tried in their order, a
    round for each place and provider: (name, provider, reader of its answers). A round asks
    for those rows alone that no round before has found. ``key`` names a row.
    """
    from quire.operators import metadata as M

    needed = M.isbn_lookup_needed(F.col(candidates), F.col("title"), F.col("author"))
    asked = rows.where(needed).select(*key, candidates)
    most = asked.agg(F.max(F.size(candidates))).first()[0] or 0
    found, news, open_ = None, None, settled(asked, "isbn-asked")
    for place in range(most):
        for name, provider, reader in providers:
            wanted = open_.where(F.size(candidates) > place).withColumn("__isbn", F.get(candidates, F.lit(place)))
            told, fresh = lookup(wanted, "__isbn", f"isbn:{name}", provider, cache if news is None else cache.select("cache_key", "payload_json").unionByName(news), parallel, every)
            told = settled(told.withColumn("__found", reader(F.col("answer_json"))).where("__found is not null").select(*key, "__isbn", "__found"), "isbn-found")
            news = fresh if news is None else news.unionByName(fresh)
            found = told if found is None else found.unionByName(told)
            open_ = settled(open_.join(told.select(*key), key, "left_anti"), "isbn-open")
    if found is None:
        return rows.withColumn("isbn", F.lit("")), cache.select("cache_key", "payload_json").limit(0)
    out = merge_isbn(rows.join(found, key, "left"), "__found", F.col("__isbn"))
    return out.drop("__found", "__isbn"), news


def route(decision: Column, snippet: Column, least_letters: int = 24, iterative: bool = False, context_allowed: bool = True) -> Column:
    """How a file is asked about: iterative, snippet, fallback_context, none, genre_only, skip."""
    full = F.lit("iterative") if iterative else F.when(T.has_letters(snippet, least_letters), "snippet").otherwise("fallback_context" if context_allowed else "none")
    return F.when(decision == "full", full).when(decision == "genre_only", "genre_only").otherwise("skip")


def outcome_counters(rows: DataFrame, outcome: str = "lm_outcome") -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))
