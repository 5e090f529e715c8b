"""Model answers: JSON with repairs, or ``key: value`` lines, to one fixed shape."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from quire.functions.content import clean_py

SHAPE = StructType([*(StructField(n, StringType()) for n in ("title", "author", "genre")), StructField("subgenres", ArrayType(StringType())), StructField("confidence", DoubleType())])
#: Labels of ``label: value`` answers by script, with the field each one fills.
_LABELS = (
    {"title": "title", "author": "author", "genre": "genre", "primary_genre": "genre", "confidence": "confidence", "confidence_score": "confidence"},
    {"название": "title", "название книги": "title", "автор": "author", "жанр": "genre", "уверенность": "confidence", "достоверность": "confidence"},
)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<mark>[{}\[\]:,])|(?P<word>[^\s{}\[\]:,"']+))""", re.DOTALL)
_WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_STRAIGHT = str.maketrans("“”„‘’", "\"\"\"''")
_DEPTH = 60


class _Reader:
    """Values of a lenient JSON: either quote, Python's words, commas before a closing bracket."""

    def __init__(self, text: str, start: int):
        self.text, self.at = text, start

    def token(self) -> tuple[str, str]:
        m = _TOKEN.match(self.text, self.at)
        if m is None:
            raise ValueError("no token")
        self.at = m.end()
        return m.lastgroup, m[m.lastgroup]

    def value(self, depth: int = 0):
        return self.of(*self.token(), depth)

    def of(self, kind: str, token: str, depth: int):
        if depth > _DEPTH:
            raise ValueError("too deep")
        if kind == "text":
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
        if kind == "word":
            return _WORDS[token] if token in _WORDS else json.loads(token)
        if token == "{":
            return dict(self.items("}", depth))
        if token == "[":
            return list(self.items("]", depth))
        raise ValueError(token)

    def items(self, end: str, depth: int):
        while (found := self.token()) != ("mark", end):
            item = self.of(*found, depth + 1)
            if end == "}":
                if not isinstance(item, str) or self.token() != ("mark", ":"):
                    raise ValueError("no key")
                item = (item, self.value(depth + 1))
            yield item
            found = self.token()
            if found == ("mark", end):
                return
            if found != ("mark", ","):
                raise ValueError("no comma")


def parse_object(text: str | None) -> dict | None:
    """The first object in ``text`` that can be read and is not empty, whatever stands around it."""
    for source in dict.fromkeys((text or "", (text or "").translate(_STRAIGHT))):
        for m in re.finditer(r"\{", source):
            try:
                if found := _Reader(source, m.start()).value():
                    return found
            except (ValueError, IndexError):
                continue
    return None


def _number(x) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return 0.0


def _words(x) -> list[str]:
    return [t for w in (x if isinstance(x, list) else [x] if x else []) if (t := clean_py(str(w)))]


#: Where a field may stand, best place first, and how it is read. An empty text of the first place
#: of a genre gives way to the next.
_PLACES = {
    "title": ((("title",),), lambda x: clean_py(str(x))),
    "author": ((("author",),), lambda x: clean_py(str(x))),
    "genre": ((("genre_analysis", "primary_genre"), ("genre",), ("primary_genre",)), lambda x: clean_py(str(x))),
    "subgenres": ((("genre_analysis", "subgenres"), ("subgenres",)), _words),
    "confidence": ((("genre_analysis", "confidence_score"), ("confidence",), ("confidence_score",)), _number),
}


def shape(payload: dict) -> dict | None:
    """title, author, genre, subgenres, confidence of a payload; only what it has."""
    while isinstance(rest := payload.get("results"), list) and rest and isinstance(rest[0], dict):
        payload = rest[0]
    inner = payload.get("genre_analysis")
    flat = {(k,): v for k, v in payload.items()}
    if isinstance(inner, dict) and inner:
        # an analysis without subgenres says that there are none
        flat |= {("genre_analysis", k): v for k, v in ({"subgenres": []} | inner).items()}
    out = {}
    for name, (places, read) in _PLACES.items():
        for place in places:
            if place not in flat or (name == "subgenres" and not flat[place] and not isinstance(flat[place], list)):
                continue
            value = read(flat[place])
            if value != "" or len(place) == 1:
                out[name] = value
                break
    return out or None


def _labelled(text: str) -> dict:
    """Fields of ``label: value`` text; the last mention counts, and the second script over the first."""
    fields = {}
    for labels in _LABELS:
        names = "|".join(sorted(labels, key=len, reverse=True)).replace(" ", r"\s+")
        for m in re.finditer(rf"""(?im)\b(?P<label>{names})\b\s*[:=\-–—]\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\n,;]+))""", text):
            fields[labels[clean_py(m["label"]).lower()]] = clean_py(m["a"] or m["b"] or m["c"] or "")
    return fields


def parse(text: str | None) -> dict | None:
    """The shape of an answer, from an object in it or else from its labelled values."""
    if found := parse_object(text):
        return shape(found)
    return shape(_labelled(text.strip().strip("`"))) if text else None


@pandas_udf(SHAPE)
def _parse(text: pd.Series) -> pd.DataFrame:
    rows = [parse(t) or {} for t in text]
    return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object if k != "confidence" else float) for k in ("title", "author", "genre", "subgenres", "confidence")})


def parse_payload(text: Column) -> Column:
    """struct(title, author, genre, subgenres, confidence); fields that are absent are null."""
    return _parse(text)


def shape_native(json_text: Column) -> Column:
    """The same shape for well-formed JSON, without Python."""
    inner = "title string, author string, genre string, primary_genre string, subgenres array<string>, confidence string, confidence_score string, genre_analysis struct<primary_genre:string,subgenres:array<string>,confidence_score:string>"
    whole = F.from_json(json_text, f"results array<struct<{', '.join(p.replace(' ', ':', 1) for p in inner.split(', '))}>>, {inner}")
    first = F.get(whole["results"], F.lit(0))
    pick = lambda name: F.coalesce(first[name], whole[name])
    deep = pick("genre_analysis")
    squeezed = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    none = F.when(deep["primary_genre"] != "", deep["primary_genre"])
    return F.struct(
        squeezed(pick("title")).alias("title"),
        squeezed(pick("author")).alias("author"),
        squeezed(F.coalesce(none, pick("genre"), pick("primary_genre"))).alias("genre"),
        F.coalesce(deep["subgenres"], pick("subgenres")).alias("subgenres"),
        F.coalesce(deep["confidence_score"], pick("confidence"), pick("confidence_score")).try_cast("double").alias("confidence"),
    )
