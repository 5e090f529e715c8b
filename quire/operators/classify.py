"""Is a file a book? An ordered list of decisions; the first that applies wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import content as B
from quire.functions import text as T


def kind_is_book(kind: Column, mime: Column, ext: Column) -> Column:
    boxed = mime.isin(C.ARCHIVE_FILETYPE_MIMES) & ext.isin(C.BOOK_ZIP_CONTAINER_EXTENSIONS)
    return F.coalesce(mime.isin(C.BOOK_FILETYPE_MIMES) | kind.isin(C.BOOK_FILETYPE_EXTENSIONS) | boxed, F.lit(False))


def kind_is_archive(kind: Column, mime: Column) -> Column:
    return F.coalesce(mime.isin(C.ARCHIVE_FILETYPE_MIMES) | kind.isin(C.ARCHIVE_KINDS), F.lit(False))


def kind_is_nonbook(kind: Column, mime: Column, ext: Column) -> Column:
    known = (F.coalesce(kind, F.lit("")) != "") | (F.coalesce(mime, F.lit("")) != "")
    return known & ~kind_is_book(kind, mime, ext) & ~kind_is_archive(kind, mime)


def book_signals(text: Column) -> Column:
    """Whether the first 1200 characters hold a word that books hold."""

    def held(head: Column) -> Column:
        out = F.lit(False)
        for token in C.BOOK_CONTENT_TOKENS:
            out = out | F.contains(head, F.lit(token))
        return out

    return T.let(F.lower(F.left(T.clean(text), F.lit(1200))), held)


def with_sidecar(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``has_sidecar``: a file of the same folder and stem ends in .fbd."""
    own = lambda: F.concat_ws("/", T.parent_of(F.col(path)), T.stem_of(F.col(path)))
    marks = files.where(T.suffix_of(F.col(path)) == ".fbd").select(own().alias("__side")).distinct()
    return files.withColumn("__own", own()).join(marks, F.col("__own") == F.col("__side"), "left").withColumn("has_sidecar", F.col("__side").isNotNull()).drop("__own", "__side")


def verdict(path: Column, size: Column, head_text: Column, has_sidecar: Column, binary: Column, magic: Column, kind: Column | None = None, mime: Column | None = None) -> Column:
    """struct(is_book, reason). ``binary`` and ``magic`` are columns made beforehand."""
    kind, mime = F.lit("") if kind is None else kind, F.lit("") if mime is None else mime
    ext, stem = T.suffix_of(path), T.stem_of(path)
    parsed = T.parse_filename(stem)
    named = (F.length(parsed["author"]) >= 3) & (F.length(parsed["title"]) >= 3)
    said = lambda yes, why: F.struct(F.lit(yes).alias("is_book"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    what = F.coalesce(F.when(mime != "", mime), F.when(kind != "", kind), F.lit("unknown"))
    shown = F.when(ext == "", "no_ext").otherwise(ext)
    text = (
        F.when(book_signals(head_text), said(True, "text_book_signals"))
        .when(named | T.looks_like_book_stem(stem), said(True, "text_book_filename"))
        .when(stem.rlike(C.PORTAL_ID), said(True, "text_library_portal_id"))
        .when(has_sidecar, said(True, "text_fbd_sidecar"))
        .otherwise(said(False, "text_no_book_signals"))
    )
    small = F.when(size < C.TINY_UNKNOWN_BINARY_BYTES, "tiny_unknown_binary:").otherwise("unknown_binary_not_book_type:")
    return (
        F.when(size == 0, said(False, "empty_file"))
        .when(kind_is_book(kind, mime, ext), said(True, F.concat(F.lit("book_filetype:"), what)))
        .when(kind_is_nonbook(kind, mime, ext), said(False, F.concat(F.lit("nonbook_filetype:"), what)))
        .when(ext == ".fb2", said(True, "book_ext:.fb2"))
        .when(ext.isin(C.TEXT_EXTENSIONS), text)
        .when(ext.isin(C.BOOK_EXTENSIONS), said(True, F.concat(F.lit("book_ext:"), ext)))
        .when(ext.isin(C.STRONG_NONBOOK_EXTENSIONS), said(False, F.concat(F.lit("nonbook_ext:"), ext)))
        .when(magic != "", said(True, F.concat(F.lit("book_magic:"), magic)))
        .when(binary, said(False, F.concat(small, shown)))
        .otherwise(said(False, F.concat(F.lit("unknown_text_not_book_type:"), shown)))
    )


def classify(files: DataFrame) -> DataFrame:
    """Adds is_book and reason to files with path, size_bytes and content.

    File kinds are told by signature; what has none is judged by name, text and bytes.
    """
    rows = with_sidecar(files).withColumn("__kind", B.kind_of(F.col("content"))).withColumn("__head", B.snippet(F.col("content"), F.col("path"), 1200))
    rows = rows.withColumn("__binary", B.looks_binary(F.substring("content", 1, 4096))).withColumn("__v", verdict(F.col("path"), F.col("size_bytes"), F.col("__head"), F.col("has_sidecar"), F.col("__binary"), B.magic(F.col("content")), F.col("__kind.ext"), F.col("__kind.mime")))
    return rows.select("*", "__v.*").drop("__kind", "__head", "__binary", "__v", "has_sidecar")
