"""File contents: hashes, charset choice, text and tags of document formats.

Bytes have to be interpreted here, so these are Arrow-batched functions; what can be told from a
few leading bytes stays in SQL.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quire import constants as C
from quire.functions import pdf
from quire.functions import text as T

_TAG, _ZERO = re.compile(r"<[^>]+>"), str.maketrans("", "", "﻿​")
_DECLARED = re.compile(rb"encoding\s*=\s*[\"']([\w\-]+)[\"']", re.IGNORECASE)
_ALIAS = {"windows-1251": "cp1251", "win-1251": "cp1251", "cp-1251": "cp1251", "windows-1252": "cp1252", "utf8": "utf-8"}
_GUESSES = ("cp1251", "koi8-r", "cp1252", "iso-8859-5", "latin1")
_UTF16 = (b"\xff\xfe", b"\xfe\xff")


_BATCH_KEY, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256


def few_rows(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A function of whole contents: they come in Arrow batches of few rows, unless the session says otherwise.

    A worker holds a batch several times over, as bytes, as text and as its result.
    """

    @functools.wraps(udf)
    def call(*columns) -> Column:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.conf.get(_BATCH_KEY) == "10000":
            spark.conf.set(_BATCH_KEY, _BATCH_ROWS)
        return udf(*columns)

    return call


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def clean_py(text: str) -> str:
    return " ".join(_TAG.sub(" ", text).translate(_ZERO).split())


def cyrillic_score(text: str) -> int:
    return sum("Ѐ" <= ch <= "ӿ" for ch in text) - 5 * text.count("�")


def decode(raw: bytes | None) -> str:
    """Text of unknown encoding: mark, declaration, strict UTF-8, then the most Cyrillic guess."""
    if not raw:
        return ""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "ignore")
    if raw[:2] in _UTF16:
        return raw.decode("utf-16", "ignore")
    tries = []
    if named := _DECLARED.search(raw[:400]):
        name = named[1].decode("ascii").lower()
        tries.append((_ALIAS.get(name, name), "ignore"))
    tries.append(("utf-8", "strict"))
    for encoding, errors in tries:
        try:
            return raw.decode(encoding, errors)
        except (LookupError, UnicodeError):
            continue
    return max((raw.decode(e, "replace") for e in _GUESSES), key=cyrillic_score)


def binary_like(head: bytes | None) -> bool:
    """Whether the first 4096 bytes look like no text."""
    head = (head or b"")[:4096]
    if not head:
        return False
    if head[:2] in _UTF16:
        try:
            head.decode("utf-16")
            return False
        except UnicodeError:
            pass
    if b"\0" in head:
        return True
    printable = sum(32 <= b <= 126 or b in b"\r\n\t\f\b" for b in head)
    return printable / len(head) < 0.65


@few_rows
@pandas_udf(StringType())
def smart_decode(raw: pd.Series) -> pd.Series:
    return raw.map(decode)


@pandas_udf(BooleanType())
def looks_binary(raw: pd.Series) -> pd.Series:
    return raw.map(binary_like)


@few_rows
@pandas_udf(StringType())
def xxh64(raw: pd.Series) -> pd.Series:
    """XXH64 with seed 0, as 16 hexadecimal digits."""
    return raw.map(lambda b: None if b is None else xxhash.xxh64(b).hexdigest())


@pandas_udf(StringType())
def _xxh64_text(text: pd.Series) -> pd.Series:
    return text.map(lambda s: xxhash.xxh64((s or "").encode("utf-8", "ignore")).hexdigest()[:8])


def shorten(x: Column, most: int) -> Column:
    """A long name cut short, with eight digits of its hash."""
    v = T.sanitize(x, 300)
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.regexp_replace(F.left(v, F.lit(max(1, most - 9))), "[ .]+$", ""), F.lit("_"), _xxh64_text(v)))


def magic(content: Column) -> Column:
    """Label of a book signature in the first bytes, or empty."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit("")
    for label, sign in reversed(C.BOOK_MAGIC):
        out = F.when(F.startswith(head, F.lit(sign)), label).otherwise(out)
    return F.when(content.isNull(), "").otherwise(out)


def kind_of(content: Column) -> Column:
    """struct(ext, mime) by the signature in the first bytes, empty if none is known."""
    head = F.coalesce(F.hex(F.substring(content, 1, 320)), F.lit(""))
    kind = lambda ext, mime: F.struct(F.lit(ext).alias("ext"), F.lit(mime).alias("mime"))
    out = kind("", "")
    for first, sign, ext, mime in reversed(C.KIND_SIGNATURES):
        out = F.when(F.substring(head, 2 * first + 1, len(sign)) == sign, kind(ext, mime)).otherwise(out)
    return out


def is_archive(path: Column, content: Column, mime: Column) -> Column:
    ext = T.suffix_of(path)
    head = F.coalesce(F.hex(F.substring(content, 1, 8)), F.lit(""))
    signed = head.startswith(C.ARCHIVE_MAGIC[0])
    for sign in C.ARCHIVE_MAGIC[1:]:
        signed = signed | head.startswith(sign)
    return F.when(ext.isin(C.BOOK_ZIP_CONTAINER_EXTENSIONS), False).otherwise(ext.isin(C.ARCHIVE_EXTENSIONS) | F.coalesce(mime.isin(C.ARCHIVE_FILETYPE_MIMES), F.lit(False)) | signed)


def _pages(raw: bytes, ext: str, most: int, ordered: bool) -> str:
    """Text of the parts of a zipped document."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        names = box.namelist()
        if ext == ".docx":
            part = "word/document.xml"
            return clean_py(box.read(part).decode("utf-8", "ignore"))[:most] if part in names else ""
        pages = [n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
        if not ordered:
            return next((t for n in pages[:3] if (t := clean_py(box.read(n).decode("utf-8", "ignore")))), "")[:most]
        out, size = [], 0
        for n in sorted(pages):
            if size >= most:
                break
            if t := clean_py(box.read(n).decode("utf-8", "ignore")):
                out.append(t)
                size += len(t)
        return "\n".join(out)[:most]


def text_of(raw: bytes | None, ext: str | None, most: int, whole: bool = False) -> str:
    """First ``most`` characters of readable text; ``whole`` reads all parts of a container."""
    try:
        if not raw:
            return ""
        if ext in C.TEXT_EXTENSIONS:
            return clean_py(decode(raw[: most * 4]))[:most]
        if ext in (".docx", ".epub"):
            return _pages(raw, ext, most, whole)
        if ext == ".pdf":
            return clean_py(pdf.text(raw, most, whole))[:most]
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, UnicodeError):
        return ""
    return ""


def snippet(content: Column, path: Column, most: int = 1800, whole: bool = False) -> Column:
    @few_rows
    @pandas_udf(StringType())
    def run(raw: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([text_of(r, e, most, whole) for r, e in zip(raw, ext, strict=True)])

    return run(content, T.suffix_of(path))


def _group(text: str, pattern: str) -> str:
    found = re.search(pattern, text, re.IGNORECASE | re.DOTALL)
    return clean_py(found[1]) if found else ""


def tags_of(raw: bytes | None, ext: str | None) -> dict[str, str]:
    """title, author and genre embedded in a document; empty where there is none."""
    none = {"title": "", "author": "", "genre": ""}
    try:
        if not raw:
            return none
        if ext == ".fb2":
            t = decode(raw[:600_000])
            one = lambda tag: _group(t, rf"<{tag}>(.*?)</{tag}>")
            return {"title": one("book-title"), "author": " ".join(x for x in (one("first-name"), one("last-name")) if x), "genre": one("genre")}
        if ext == ".pdf":
            return none | {k: clean_py(v) for k, v in pdf.tags(raw).items()}
        if ext not in (".epub", ".docx"):
            return none
        with zipfile.ZipFile(io.BytesIO(raw)) as box:
            names, place = set(box.namelist()), "docProps/core.xml"
            read = lambda n: box.read(n).decode("utf-8", "ignore") if n in names else ""
            if ext == ".epub":
                found = re.search(r'full-path="([^"]+)"', read("META-INF/container.xml"))
                place = found[1] if found else ""
            t = read(place)
            return {k: _group(t, rf"<dc:{tag}[^>]*>(.*?)</dc:{tag}>") for k, tag in (("title", "title"), ("author", "creator"), ("genre", "subject"))}
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, UnicodeError):
        return none


def tags(content: Column, path: Column) -> Column:
    """struct(title, author, genre)"""

    @few_rows
    @pandas_udf(_strings("title", "author", "genre"))
    def run(raw: pd.Series, ext: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tags_of(r, e) for r, e in zip(raw, ext, strict=True)], columns=["title", "author", "genre"])

    return run(content, T.suffix_of(path))


def payload_hash(raw: bytes | None) -> tuple[str | None, str]:
    """(XXH64 of the largest member, books first, and a note on failure) of a ZIP file."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as box:
            files = [i for i in box.infolist() if not i.is_dir()]
            if not files:
                return None, "empty_zip"
            rank = lambda i: (f".{i.filename.rpartition('.')[2].lower()}" in C.BOOK_EXTENSIONS, i.file_size)
            best, digest = max(files, key=rank), xxhash.xxh64()
            with box.open(best) as part:
                while piece := part.read(4 << 20):
                    digest.update(piece)
            return digest.hexdigest(), ""
    except zipfile.BadZipFile:
        return None, "bad_zip"
    except (OSError, RuntimeError, KeyError) as error:
        return None, type(error).__name__


@few_rows
@pandas_udf(_strings("xxh64", "note"))
def zip_payload_hash(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([payload_hash(r) for r in raw], columns=["xxh64", "note"])
