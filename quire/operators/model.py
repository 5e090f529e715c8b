"""Asking a model about books: the order of requests, their outcomes, and name translation.

A model is a provider (see ``lookup``): from requests to JSON answers. Requests are columns, so what
is asked, of whom and how often is part of the plan; answers come through the cache.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import payload as P
from quire.functions import text as T
from quire.operators import metadata as M
from quire.operators.enrich import Provider, lookup, route, stub_provider
from quire.sources.state import settled

#: Answers that say "this form of request is not understood": the next form may be.
UNSUPPORTED = (400, 404, 409, 415, 422)


def chat_bodies(model: str, messages: list[dict], most_tokens: int) -> list[dict]:
    """The forms of a chat request that servers take, strictest first."""
    plain = {"model": model, "messages": messages}
    usual = plain | {"temperature": 0.0, "max_tokens": most_tokens}
    return [usual | {"response_format": {"type": "json_object"}}, usual, plain, plain | {"max_completion_tokens": most_tokens}]


def chat_provider(post: Callable[[dict], tuple[int, str]], model: str, system: str, most_tokens: int = 400, tries: int = 2) -> Provider:
    """A provider from ``post``, which sends a body and gives (status, content).

    An answer that holds no object is asked for once more, with a word on the format.
    """

    def say(messages: list[dict]) -> str | None:
        for body in chat_bodies(model, messages, most_tokens):
            status, content = post(body)
            if status == 200:
                return content
            if status not in UNSUPPORTED:
                return None
        return None

    def ask(requests: list[str]) -> list[str | None]:
        out = []
        for request in requests:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": request}]
            answer = None
            for _ in range(tries):
                said = say(messages)
                if said is None:
                    break
                if P.parse(said):
                    answer = said
                    break
                messages = [*messages, {"role": "assistant", "content": said}, {"role": "user", "content": "Answer with one JSON object only."}]
            out.append(answer)
        return out

    return ask


def iterative_provider(talk: Callable[[list[str]], str | None], enough: float = 4.5, most: int = 8) -> Provider:
    """Requests are JSON lists of text pieces, given one after the other while the model wants more.

    ``talk`` gets the pieces so far. The last answer with an object counts.
    """

    def one(request: str) -> str | None:
        pieces, best = json.loads(request)[:most], None
        for k in range(len(pieces)):
            said = talk(pieces[: k + 1])
            found = P.parse_object(said)
            if found is None:
                continue
            best = said
            sure = (P.shape(found) or {}).get("confidence", 0.0)
            if found.get("need_more_text") is False or sure >= enough:
                break
        return best

    return lambda requests: [one(r) for r in requests]


def ask_rounds(rows: DataFrame, key: str, pieces: str, provider: Provider, cache: DataFrame, enough: float = 4.5, most: int = 8, parallel: int | None = None, every: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, answer_json, rounds) of keys that got an answer, and the new cache rows.

    Round k asks with the first k pieces of a text, a JSON list, for those keys alone whose answer so
    far wants more text and is not sure ``enough``. What a round learns is written before the next,
    so a run that dies goes on from the cache. The last answer with fields counts. Rows of one key
    have the same pieces.
    """
    texts = settled(rows.where(F.col(key).isNotNull() & (F.size(pieces) > 0)).groupBy(key).agg(F.slice(F.first(pieces), 1, most).alias("__pieces")), "round-texts")
    state = texts.select(key, F.size("__pieces").alias("__size"), F.lit(None).cast("string").alias("answer_json"), F.lit(0).alias("rounds"), F.lit(True).alias("__open"))
    news = None
    for k in range(1, most + 1):
        open_ = F.col("__open") & (F.col("__size") >= k)
        if state.where(open_).isEmpty():
            break
        wanted = state.where(open_).select(key).join(texts, key).select(key, F.to_json(F.slice("__pieces", 1, k)).alias("__request"))
        told, fresh = lookup(wanted, "__request", "pieces", provider, cache if news is None else cache.select("cache_key", "payload_json").unionByName(news), parallel, every)
        news = fresh if news is None else news.unionByName(fresh)
        # fields are read first, so that an answer which is no answer leaves the one before
        told = told.withColumn("__p", P.parse_payload(F.col("answer_json")))
        useful = F.coalesce(*(F.col(f"__p.{c}").cast("string") for c in ("title", "author", "genre", "confidence"))).isNotNull()
        stops = F.col("answer_json").rlike(r'"need_more_text"\s*:\s*false') | (F.coalesce("__p.confidence", F.lit(0.0)) >= enough)
        told = told.select(F.col(key).alias("__key"), F.when(useful, F.col("answer_json")).alias("__new"), F.coalesce(useful & stops, F.lit(False)).alias("__stop"))
        state = state.join(told, F.col(key) == F.col("__key"), "left")
        asked = F.col("__key").isNotNull()
        state = state.select(key, "__size", F.coalesce("__new", "answer_json").alias("answer_json"), F.when(asked, k).otherwise(F.col("rounds")).alias("rounds"), (F.col("__open") & ~F.coalesce("__stop", F.lit(False))).alias("__open"))
        state = settled(state, "rounds")
    if news is None:
        news = cache.select("cache_key", "payload_json").limit(0)
    return state.where("answer_json is not null").select(key, "answer_json", "rounds"), news


@dataclass(frozen=True)
class Asking:
    """Who is asked and when. Columns: ``context`` and ``snippet``, and ``pieces`` for iteration.

    ``rounds`` is asked piece by piece in rounds of the plan (``ask_rounds``), ``iterative`` gets all
    pieces of a text in one call. ``every``: seconds between two calls of a kind, by the whole cluster.
    """

    fast: Provider | None = stub_provider
    full: Provider = stub_provider
    genre: Provider = stub_provider
    iterative: Provider | None = None
    rounds: Provider | None = None
    least_letters: int = 24
    context_allowed: bool = True
    fast_confidence: float = 4.0
    sure: float = 4.5
    parallel: dict[str, int] = field(default_factory=dict)
    every: dict[str, float] = field(default_factory=dict)


def _asked(rows: DataFrame, request: Column, kind: str, provider: Provider, cache: DataFrame, asking: Asking) -> tuple[DataFrame, DataFrame]:
    """``rows`` with struct ``kind`` (null where there is no answer)."""
    rows, fresh = lookup(rows.withColumn("__request", request), "__request", kind, provider, cache, asking.parallel.get(kind), asking.every.get(kind))
    return _parsed(rows, kind), fresh


def _parsed(rows: DataFrame, kind: str) -> DataFrame:
    """Struct ``kind`` in place of answer_json."""
    parsed = P.parse_payload(F.col("answer_json"))
    rows = rows.withColumn("__p", parsed).withColumn(kind, F.when(F.coalesce(*(F.col(f"__p.{c}").cast("string") for c in ("title", "author", "genre", "confidence"))).isNotNull(), F.col("__p")))
    return rows.drop("__request", "answer_json", "__p")


def ask(rows: DataFrame, asking: Asking, cache: DataFrame, decision: str = "lm_decision") -> tuple[DataFrame, DataFrame]:
    """``rows`` with merged answers and ``lm_stats`` (what was asked and came of it); new cache rows.

    full: first from the context alone; if that is not strong, by pieces, from the snippet, or from
    the context again. genre_only: a genre for known names. Others are left as they are. A row
    without an answer goes on unchanged.
    """
    columns = rows.columns
    rows = settled(rows, "asked")  # what made the rows does not run again for each lookup
    full, genre_only = F.col(decision) == "full", F.col(decision) == "genre_only"
    news = []
    if asking.fast:
        rows, fresh = _asked(rows, F.when(full, F.col("context")), "fast", asking.fast, cache, asking)
        news.append(fresh)
    else:
        rows = rows.withColumn("fast", F.lit(None).cast(P.SHAPE))
    strong = F.coalesce(M.strong_answer(F.col("fast.title"), F.col("fast.genre"), F.col("fast.confidence").cast("string"), asking.fast_confidence), F.lit(False))
    rows = rows.withColumn("__more", full & ~strong)
    if asking.rounds:
        rows = settled(rows.withColumn("__pieces_key", F.when(F.col("__more") & (F.size("pieces") > 0), F.sha2(F.to_json("pieces"), 256))), "rounds-asked")
        answers, fresh = ask_rounds(rows, "__pieces_key", "pieces", asking.rounds, cache, asking.sure, parallel=asking.parallel.get("slow"), every=asking.every.get("slow"))
        rows = _parsed(rows.join(answers.drop("rounds"), "__pieces_key", "left").drop("__pieces_key"), "slow").withColumn("__input", F.lit("iterative"))
    elif asking.iterative:
        rows, fresh = _asked(rows, F.when(F.col("__more") & (F.size("pieces") > 0), F.to_json("pieces")), "slow", asking.iterative, cache, asking)
        rows = rows.withColumn("__input", F.lit("iterative"))
    else:
        way = route(F.lit("full"), F.col("snippet"), asking.least_letters, False, asking.context_allowed)
        rows = rows.withColumn("__input", way)
        given = F.when(F.col("__input") == "snippet", F.col("snippet")).when(F.col("__input") == "fallback_context", F.col("context"))
        rows, fresh = _asked(rows, F.when(F.col("__more"), given), "slow", asking.full, cache, asking)
    news.append(fresh)
    rows, fresh = _asked(rows, F.when(genre_only, F.col("context")), "genre_answer", asking.genre, cache, asking)
    news.append(fresh)

    said = lambda when, word: F.when(when, F.array(F.lit(word))).otherwise(F.array().cast("array<string>"))
    more, by_pieces, nothing = F.col("__more"), F.col("__input") == "iterative", F.col("__input") == "none"
    had_fast, had_slow, had_genre = (F.col(c).isNotNull() for c in ("fast", "slow", "genre_answer"))
    tried = F.lit(asking.fast is not None)
    stats = F.concat(
        said(full & tried, "fast_request"), said(full & strong, "fast_ok"), said(more & had_fast, "fast_fallback"), said(more & tried & ~had_fast, "fast_no_result"),
        said(more & by_pieces, "iter_request"), said(more & by_pieces & had_slow, "iter_ok"), said(more & by_pieces & ~had_slow, "iter_no_result"),
        said(more & nothing, "full_skipped_no_input"), said(more & ~by_pieces & ~nothing, "full_request"),
        said(more & ~by_pieces & ~nothing & had_slow, "full_ok"), said(more & ~by_pieces & ~nothing & ~had_slow, "full_no_result"),
        said(genre_only, "genre_only_request"), said(genre_only & had_genre, "genre_only_ok"), said(genre_only & ~had_genre, "genre_only_no_result"),
        said(~full & ~genre_only, "skipped"), F.array(F.lit("processed")),
    )
    answer = F.when(strong, F.col("fast")).when(more, F.col("slow")).when(genre_only, F.col("genre_answer"))
    rows = M.merge_answer(rows.withColumn("lm_stats", stats).withColumn("answer", answer.withField("confidence", answer["confidence"].cast("string"))), sure=asking.sure)
    new = news[0]
    for fresh in news[1:]:
        new = new.unionByName(fresh)
    return rows.select(*columns, "lm_stats"), new


def stats_counters(rows: DataFrame) -> DataFrame:
    """How often each outcome came up."""
    return rows.select(F.explode("lm_stats").alias("lm_outcome")).groupBy("lm_outcome").agg(F.count("*").alias("n"))


def translate_names(rows: DataFrame, provider: Provider, cache: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    """Title and author in the script of ``lang``; names already in it are not asked about."""
    columns = rows.columns
    there = T.in_script(F.col("title"), lang) & T.in_script(F.col("author"), lang)
    request = F.when(~there, F.to_json(F.struct(F.lit(lang).alias("language"), "title", "author")))
    rows, fresh = lookup(rows.withColumn("__request", request), "__request", f"names:{lang}", provider, cache)
    told = F.from_json("answer_json", "title string, author string")
    for c in ("title", "author"):
        new = T.clean(told[c])
        rows = rows.withColumn(f"__{c}", F.when(new != "", new).otherwise(F.col(c)))
    return rows.select(*(F.col(f"__{c}").alias(c) if c in ("title", "author") else F.col(c) for c in columns)), fresh


def brief(*names: str) -> Column:
    """The named metadata columns as JSON, without those that say nothing."""
    shown = F.struct(*(F.when(~F.col(c).cast("string").isin("", "Unknown"), F.col(c)).alias(c) for c in names))
    return F.to_json(shown)
