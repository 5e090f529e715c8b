"""Metadata: assembly from name, tags and path; choice of names; merging of outside answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import genre as G
from quire.functions import isbn as I
from quire.functions import text as T


def assemble(files: DataFrame, prefer_tags: bool = False) -> DataFrame:
    """Adds title, author, genre, source, confidence to files with path, archive_chain and tags.

    The file name gives the title whenever it is not empty, embedded tags fill what is missing
    (``prefer_tags`` turns that round); a tag genre wins, then path, then title.
    """
    parsed, tags = F.col("__p"), {k: F.coalesce(F.col(f"tags.{k}"), F.lit("")) for k in ("title", "author", "genre")}
    rows = files.withColumn("__p", T.parse_filename(T.stem_of(F.col("path"))))
    pick = lambda own, tag: F.when(tag != "", tag).otherwise(own) if prefer_tags else F.when(own != "", own).otherwise(tag)
    title, author = pick(parsed["title"], tags["title"]), pick(parsed["author"], tags["author"])
    tag_used = (tags["genre"] != "") | ((tags["title"] != "") & (F.lit(prefer_tags) | (parsed["title"] == ""))) | ((tags["author"] != "") & (F.lit(prefer_tags) | (parsed["author"] == "")))
    named = (parsed["title"] != "") | (parsed["author"] != "")
    rows = rows.withColumn("__t", title).withColumn("__a", author).withColumn("__g", F.when(tags["genre"] != "", G.normalize(tags["genre"])).otherwise(""))
    rows = rows.withColumn("__path", F.when(F.col("__g") == "", G.from_path(F.col("path"), F.col("archive_chain"))).otherwise(""))
    rows = rows.withColumn("__g", F.when(F.col("__g") == "", F.col("__path")).otherwise(F.col("__g")))
    rows = rows.withColumn("__title", F.when(F.col("__g").isin("", "Unknown"), G.from_title(F.col("__t"))).otherwise(""))
    rows = rows.withColumn("__g", F.when(F.col("__title") != "", F.col("__title")).otherwise(F.col("__g")))
    steps = [(named, 0.35, "filename"), (tag_used, 0.75, "tags"), (F.col("__path") != "", 0.5, "path"), (F.col("__title") != "", 0.55, "title")]
    source = F.when(tag_used, "tags").when(named, "filename").when(F.col("__path") != "", "path").when(F.col("__title") != "", "title").otherwise("none")
    return rows.select(
        *files.columns,
        F.when(F.col("__t") != "", F.col("__t")).otherwise(T.stem_of(F.col("path"))).alias("title"),
        F.when(F.col("__a") != "", F.col("__a")).otherwise("Unknown Author").alias("author"),
        F.when(F.col("__g") != "", F.col("__g")).otherwise("Unknown").alias("genre"),
        source.alias("source"),
        F.greatest(F.lit(0.0), *(F.when(ok, v).otherwise(0.0) for ok, v, _ in steps)).alias("confidence"),
    )


def isbn_candidates(path: Column, fields: list[Column], text: Column) -> Column:
    """From name and known fields; from the text only if they give none."""
    from_fields = I.extract(F.concat_ws("\n", T.name_of(path), T.stem_of(path), *fields))
    return T.let(from_fields, lambda found: F.when(F.size(found) > 0, found).otherwise(I.extract(F.left(text, F.lit(1600)))))


def _some(x: Column) -> Column:
    """x unless it is empty or garbage, else null."""
    return T.let(T.text_of(x), lambda v: F.when((v != "") & ~T.is_garbage(v), v))


def best_title(title: Column, path: Column, chain: Column) -> Column:
    """Metadata, 'author - title' names of file or archives, a wordy archive name, the file name."""
    words = lambda t: F.filter(F.split(t, " "), lambda w: w.rlike(r"^\p{L}{3,}$"))

    def of_archives(good: Column) -> Column:
        full = F.filter(good, lambda p: p["author"] != "")
        wordy = F.filter(good, lambda p: F.size(words(p["title"])) >= 2)
        return F.coalesce(F.get(full, F.lit(0))["title"], F.get(wordy, F.lit(0))["title"])

    archives = F.filter(F.transform(chain, lambda a: T.parse_filename(T.stem_of(a))), lambda p: (p["title"] != "") & ~T.is_garbage(p["title"]))
    return T.let(T.parse_filename(T.stem_of(path)), lambda own: F.coalesce(_some(title), F.when(own["author"] != "", _some(own["title"])), T.let(archives, of_archives), _some(own["title"]), T.stem_of(path)))


def best_author(author: Column, path: Column, chain: Column) -> Column:
    archives = F.filter(F.transform(chain, lambda a: T.parse_filename(T.stem_of(a))["author"]), lambda a: (a != "") & ~T.is_garbage(a))
    return F.coalesce(_some(author), _some(T.parse_filename(T.stem_of(path))["author"]), F.get(archives, F.lit(0)), F.lit("Unknown Author"))


def _low(x: Column) -> Column:
    return F.lower(F.trim(T.text_of(x)))


def missing_title(title: Column) -> Column:
    return _low(title).isin("", *C.UNKNOWN_TITLES) | T.is_garbage(title)


def missing_author(author: Column) -> Column:
    return _low(author).isin("", *C.UNKNOWN_AUTHORS)


def needs_model(title: Column, author: Column, source: Column, confidence: Column, fill_author: bool = True) -> Column:
    sure = (source == "tags") & (confidence >= 0.75) & ~T.is_garbage(title)
    return ~sure & (missing_title(title) | (missing_author(author) if fill_author else F.lit(False)))


def needs_genre_only(title: Column, author: Column, genre: Column) -> Column:
    return ~missing_title(title) & ~missing_author(author) & _low(genre).isin("", "unknown")


def decision(title: Column, author: Column, genre: Column, source: Column, confidence: Column, force: bool = False, fill_author: bool = True) -> Column:
    """full, genre_only, or the reason to skip."""
    if force:
        return F.lit("full")
    return F.when(needs_model(title, author, source, confidence, fill_author), "full").when(needs_genre_only(title, author, genre), "genre_only").when((source == "tags") & (confidence >= 0.75), "skip:tags_confident").otherwise("skip:metadata_sufficient")


def strong_answer(title: Column, genre: Column, confidence: Column, least: float = 4.0) -> Column:
    """A known title and genre and enough confidence; the author may be unknown."""
    known = ~F.lower(T.clean(title)).isin("", *C.UNKNOWN_TITLES)
    return known & (G.normalize(genre) != "Unknown") & (F.coalesce(confidence.try_cast("double"), F.lit(0.0)) >= least)


def isbn_lookup_needed(candidates: Column, title: Column, author: Column) -> Column:
    return (F.size(candidates) > 0) & ((T.text_of(title) == "") | T.is_garbage(title) | missing_author(author))


def merge_answer(rows: DataFrame, answer: str = "answer", sure: float = 4.5) -> DataFrame:
    """Metadata columns with a model's answer (a struct, null if none) merged in.

    Placeholders never overwrite; a known genre gives way only to a confidence of ``sure``.
    """
    a = {k: T.clean(F.col(f"{answer}.{k}")) for k in ("title", "author", "genre")}
    conf = F.coalesce(F.col(f"{answer}.confidence").try_cast("double"), F.lit(0.0))
    trusted = ~_low(F.col("genre")).isin("", "unknown")
    use = lambda k: (a[k] != "") & ~T.is_garbage(a[k])
    said = F.coalesce((a["title"] != "") | (a["author"] != "") | (a["genre"] != ""), F.lit(False))
    merged = {
        "title": F.when(use("title"), a["title"]).otherwise(F.col("title")),
        "author": F.when(use("author"), a["author"]).otherwise(F.col("author")),
        "genre": F.when((a["genre"] != "") & (~trusted | (conf >= sure)), G.normalize(a["genre"])).otherwise(F.col("genre")),
        "confidence": F.greatest("confidence", conf),
        "source": F.when(said, "model").otherwise(F.col("source")),
    }
    return rows.select(*(merged[c].alias(c) if c in merged else F.col(c) for c in rows.columns))
