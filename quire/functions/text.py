"""Text and path functions, Column to Column. Null counts as the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C

#: White space as Unicode has it, with the four ASCII separators.
WS = r"[\s\u001c-\u001f\u0085\p{Z}]"


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it; keeps generated code small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(text_of(x), "<[^>]+>", " ")


def clean(x: Column) -> Column:
    """Without tags and zero-width marks, white space squeezed."""
    return squeeze(F.regexp_replace(strip_tags(x), "[﻿​]", ""))


def first_group(x: Column, pattern: str) -> Column:
    return clean(F.regexp_extract(text_of(x), f"(?isU){pattern}", 1))


def strip_chars(x: Column, chars: str) -> Column:
    """Without the given characters (a regex class body) at either end."""
    return F.regexp_replace(x, f"^[{chars}]+|[{chars}]+$", "")


def sanitize(x: Column, most: int = 90) -> Column:
    """A name that any file system takes."""
    v = squeeze(strip_chars(F.regexp_replace(clean(x), C.INVALID_FS_CHARS, "_"), " ."))
    cut = let(v, lambda w: F.when(F.length(w) > most, F.regexp_replace(F.left(w, F.lit(most)), "[ .]+$", "")).otherwise(w))
    return let(cut, lambda w: F.when(w == "", "Unknown").otherwise(w))


def first_letter(author: Column) -> Column:
    v = clean(author)
    return F.when(v.rlike(r"^[\p{L}\p{N}]"), F.upper(F.left(v, F.lit(1)))).otherwise("#")


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 3)), F.lit("..."))).otherwise(x)


def is_garbage(x: Column) -> Column:
    """A placeholder, a machine number (but not a short one such as a year), or under two characters."""

    def judged(v: Column) -> Column:
        numeric = v.rlike(rf"^(?:\p{{Nd}}|[_.\-]|{WS})+$") & (F.contains(v, F.lit("_")) | (F.length(F.regexp_replace(v, rf"[_.\-]|{WS}", "")) >= 5))
        return v.isin(C.SKIP_VALUES) | numeric | (F.length(v) < 2)

    return let(F.lower(clean(x)), judged)


def has_letters(x: Column, least: int = 24) -> Column:
    return F.length(F.regexp_replace(clean(x), r"[^\p{L}]", "")) >= least


def in_script(x: Column, lang: str) -> Column:
    """Whether 60 % of the letters are of the language's script; too few letters count as yes."""
    letters = F.length(F.regexp_replace(text_of(x), r"[^\p{L}]", ""))
    own = r"[^\p{L}&&[Ѐ-ӿ]]" if lang == "ru" else "[^A-Za-z]"
    return (letters < 3) | (F.length(F.regexp_replace(text_of(x), own, "")) >= 0.6 * letters)


def parse_filename(stem: Column) -> Column:
    """struct(author, title) by the first pattern that fits; else the whole stem is the title."""

    def parsed(v: Column) -> Column:
        out = F.struct(F.lit("").alias("author"), v.alias("title"))
        for first, pattern in reversed(C.FILENAME_PATTERNS):
            full = f"(?U){pattern}"
            one, two = clean(F.regexp_extract(v, full, 1)), clean(F.regexp_extract(v, full, 2))
            pair = F.struct(one.alias("author"), two.alias("title")) if first == "author" else F.struct(two.alias("author"), one.alias("title"))
            out = F.when(v.rlike(full), pair).otherwise(out)
        return out

    return let(clean(F.replace(text_of(stem), F.lit("_"), F.lit(" "))), parsed)


def looks_like_book_stem(stem: Column) -> Column:
    """Three or more parts between underscores, two of them capitalised words; no dashes."""
    parts = F.filter(F.split(stem, "_"), lambda p: F.length(p) >= 2)
    return ~stem.rlike("[-–—]") & (F.size(parts) >= 3) & (F.size(F.filter(parts, lambda p: p.rlike(r"^\p{Lu}\p{L}*$"))) >= 2)


_EDGE = r"^[ .,\-—–:]+"


def clean_book_title(title: Column, author: Column) -> Column:
    """Without a machine number at the end and without the author's name at the start."""

    def without_number(t: Column) -> Column:
        cut = F.trim(F.regexp_replace(t, f"(?U){C.TRAILING_ID}", ""))
        return let(cut, lambda c: F.when((c != "") & ~is_garbage(c), c).otherwise(t))

    return F.trim(let(let(clean(title), without_number), lambda t: let(clean(author), lambda a: _without_author(t, a))))


def _without_author(t: Column, a: Column) -> Column:
    or_whole = lambda rest: let(rest, lambda r: F.when((r != "") & ~is_garbage(r), r).otherwise(t))
    plain = F.regexp_replace(F.substring(t, F.length(a) + 1, F.length(t)), _EDGE, "")
    names = F.transform(F.filter(F.split(a, r"[\s.]+"), lambda p: F.length(p) > 1), F.lower)
    known = (a != "") & ~F.lower(a).isin("unknown author", "неизвестный автор")
    starts = F.startswith(F.lower(t), F.lower(a))
    swapped = let(F.struct(names.alias("n"), F.split(t, f"{WS}+").alias("w")), lambda z: _after_names(t, z, or_whole))
    return F.when(known & starts, F.when(F.length(t) > F.length(a) + 1, or_whole(plain)).otherwise(t)).when(known, swapped).otherwise(t)


def _after_names(t: Column, z: Column, or_whole) -> Column:
    """What follows the words at the start that belong to the author, in whatever order."""
    names, words = z["n"], z["w"]
    in_name = lambda w: F.array_contains(names, strip_chars(F.lower(w), ".,"))
    lead = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, w: let(s["on"] & in_name(w), lambda yes: F.struct((s["n"] + yes.cast("int")).alias("n"), yes.alias("on"))), lambda s: s["n"])
    rest = F.regexp_replace(F.array_join(F.slice(words, lead + 1, F.greatest(F.size(words), F.lit(1))), " "), _EDGE, "")
    fits = (F.size(names) >= 2) & F.forall(names, lambda p: F.contains(F.lower(t), p)) & F.array_contains(names, F.lower(F.get(words, F.lit(0))))
    return F.when(fits, or_whole(rest)).otherwise(t)


# --- paths: '/' separates, a leading dot makes no suffix ----------------------------------------
def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*/*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")


def is_under(path: Column, parent: Column) -> Column:
    return (path == parent) | F.startswith(path, F.concat(parent, F.lit("/")))


def relative(path: Column, base: Column) -> Column:
    """Path below ``base``, or the bare name if it lies elsewhere."""
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(name_of(path))


def error_bucket(stem: Column) -> Column:
    v = F.upper(F.left(F.regexp_replace(text_of(stem), r"[^\p{L}\p{N}]", ""), F.lit(2)))
    return F.when(v == "", "__").otherwise(v)


def duplicate_path(root: str, digest: Column, path: Column, archive: Column) -> Column:
    name = F.concat(stem_of(path), suffix_of(path))
    name = F.when(archive.isNotNull(), F.concat(stem_of(archive), F.lit("__"), name)).otherwise(name)
    return F.concat_ws("/", F.lit(root), F.left(digest, F.lit(12)), name)


def nobook_path(root: str, path: Column, base: Column, chain: Column, keep_archives: bool = False) -> Column:
    plain = F.concat_ws("/", F.lit(root), relative(path, base))
    if not keep_archives:
        return plain
    tail = F.when(F.size(chain) >= 3, F.slice(chain, -3, 3)).otherwise(chain)
    return F.when(F.size(chain) > 0, F.concat_ws("/", F.lit(root), F.lit("FromArchives"), sanitize(F.array_join(tail, "__")), name_of(path))).otherwise(plain)


def destination_path(root: str, genre: Column, author: Column, title: Column) -> Column:
    """<root>/<genre>/<first letter>/<author>/<title>.zip"""
    return F.concat(F.concat_ws("/", F.lit(root), sanitize(genre, 48), first_letter(author), sanitize(author, 64), sanitize(title, 110)), F.lit(".zip"))


def metadata_of_destination(path: Column, base: Column) -> Column:
    """struct(title, author, genre): read back from a destination path."""
    parts = F.split(relative(path, base), "/")
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    return F.struct(stem_of(path).alias("title"), at(-2).alias("author"), at(-4).alias("genre"))


def duration_hms(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    shown = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(seconds.isNull(), "--:--:--").otherwise(shown)


def split_sources(x: Column) -> Column:
    """Distinct non-empty entries between semicolons or line ends, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text_of(x), "[;\n\r]+"), lambda p: F.trim(p)), lambda p: p != ""))


def fallback_context(path: Column, chain: Column, most: int = 700) -> Column:
    """Labelled facts about a file, for a model that gets no text of it."""
    parsed = parse_filename(stem_of(path))
    line = lambda label, v, ok: F.when(ok, F.concat(F.lit(f"{label}: "), v))
    always = F.lit(True)
    lines = [
        line("Filename", name_of(path), always),
        line("Stem", stem_of(path), always),
        line("Suffix", suffix_of(path), always),
        line("Parent", name_of(parent_of(path)), always),
        line("Archive chain", F.array_join(chain, " -> "), F.size(chain) > 0),
        line("Possible author from filename", parsed["author"], parsed["author"] != ""),
        line("Possible title from filename", parsed["title"], parsed["title"] != ""),
    ]
    return F.left(clean(F.concat_ws("\n", *lines)), F.lit(most))


def text_chunks(x: Column, size: int, most: int) -> Column:
    """Up to ``most`` consecutive pieces of ``size`` characters."""
    n = F.least(F.ceil(F.length(x) / size).cast("int"), F.lit(most))
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(x, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
