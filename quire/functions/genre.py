"""Genre normalisation by ordered rules.

Rules are tried in order and the first with a key inside the text wins. Keys may lie inside other
words ('art' in 'party'): that is meant. A rule is one regular expression over its quoted keys, so
the order of rules, not the place of a match, decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.text import WS, clean, let, text_of


def _any_of(keys: tuple[str, ...]) -> str:
    return "|".join(re.escape(k).replace("\\ ", " ") for k in keys)


def _first_rule(hits: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for hit, genre in hits:
        out = F.when(hit, genre) if out is None else out.when(hit, genre)
    return out.otherwise(default)


def normalize(genre: Column) -> Column:
    return let(clean(genre), lambda raw: let(F.lower(raw), lambda low: _normalized(raw, low)))


def _normalized(raw: Column, low: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(low, r"[_/\\|;:,\-]+", " "), f"{WS}+", " "))
    both = F.concat(spaced, F.lit("\n"), low)  # no key holds a line end
    rules = let(both, lambda b: _first_rule([(b.rlike(_any_of(keys)), out) for out, keys in C.GENRE_RULES], "Unknown"))
    exact = _first_rule([(low == name.lower(), name) for name in C.GENRES], "")
    bad = low.isin("", *C.GENRE_PLACEHOLDERS) | raw.rlike(C.GENRE_NOISE) | raw.rlike(rf"^(?:\p{{Nd}}|{WS}|[._#;,:/\\-])+$")
    bad = bad | (F.length(raw) > 64) | (F.length(F.regexp_replace(raw, r"\P{Nd}", "")) >= 5)
    return F.when(bad, "Unknown").when(exact != "", exact).otherwise(rules)


def from_title(title: Column) -> Column:
    """Genre of a title, empty if none."""
    g = normalize(F.lower(clean(title)))
    return F.when(g == "Unknown", "").otherwise(g)


def from_path(path: Column, chain: Column | None = None) -> Column:
    """Genre by the first keyword inside the path or the names of enclosing archives, else empty."""
    inside = F.lower(F.concat_ws(" ", text_of(path), F.array_join(chain, " ") if chain is not None else F.lit(""), F.replace(text_of(path), F.lit("/"), F.lit(" "))))
    return _first_rule([(inside.rlike(_any_of(keys)), out) for out, keys in C.PATH_GENRES], "")


def output_language(language: str, gui_language: str = "ru") -> str:
    lang = (language or "").strip().lower()
    return "en" if (gui_language if lang == "auto" else lang).startswith("en") else "ru"


def translated(genre: Column, language: str) -> Column:
    g = normalize(F.coalesce(genre, F.lit("Unknown")))
    if output_language(language) != "en":
        return g
    names = F.create_map(*(F.lit(x) for pair in C.GENRES.items() for x in pair))
    return F.coalesce(names[g], g)
