"""Archive members as rows, nested archives included, without writing to disk.

Depth, members and bytes of one archive are bounded by parameters; what lies beyond is reported in
``note`` and never silently left out.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C

_PACKED = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
_TARS = (".tar", ".tgz", ".tbz", ".tbz2", ".txz", ".tar.gz", ".tar.bz2", ".tar.xz")
_BROKEN = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError)


def _suffix(name: str) -> str:
    base = name.rpartition("/")[2]
    return f".{base.rpartition('.')[2].lower()}" if "." in base.lstrip(".") else ""


def archive_like(name: str, head: bytes) -> bool:
    ext = _suffix(name)
    if ext in C.BOOK_ZIP_CONTAINER_EXTENSIONS:
        return False
    return ext in C.ARCHIVE_EXTENSIONS or any(head.startswith(bytes.fromhex(s)) for s in C.ARCHIVE_MAGIC)


class TooLarge(Exception):
    """A member that goes beyond the bytes an archive may unpack to."""


def read_up_to(stream, most: int, piece: int = 1 << 20) -> bytes:
    """All of ``stream``, read in pieces, so that nothing far beyond ``most`` is ever held."""
    out = bytearray()
    while part := stream.read(piece):
        out += part
        if len(out) > most:
            raise TooLarge
    return bytes(out)


def members(name: str, raw: bytes, most: Callable[[], int] = lambda: 1 << 62) -> Iterator[tuple[str, bytes]]:
    """(member, content) of one archive level; names are read, never used as paths.

    ``most`` tells how many bytes the next member may have.
    """
    low = name.lower()
    if raw[:4] == b"PK\x03\x04" or raw[:4] == b"PK\x05\x06":
        with zipfile.ZipFile(io.BytesIO(raw)) as box:
            for info in box.infolist():
                if not info.is_dir():
                    with box.open(info) as stream:
                        yield info.filename, read_up_to(stream, most())
    elif low.endswith(_TARS):
        with tarfile.open(fileobj=io.BytesIO(raw)) as box:
            for info in box:
                if info.isfile():
                    yield info.name, read_up_to(box.extractfile(info), most())
    elif (ext := _suffix(name)) in _PACKED:
        with _PACKED[ext](io.BytesIO(raw)) as stream:
            yield name.rpartition("/")[2][: -len(ext)], read_up_to(stream, most())
    else:
        raise ValueError("unsupported archive")


def walk(name: str, raw: bytes, most_depth: int, most_members: int, most_bytes: int) -> Iterator[tuple[list[str], str, bytes | None, str]]:
    """(chain, member, content, note), outermost archive first in the chain."""
    todo, seen, size = [([name.rpartition("/")[2]], raw)], 0, 0
    while todo:
        chain, body = todo.pop()
        try:
            empty = True
            for member, content in members(chain[-1], body, lambda: most_bytes - size):
                empty = False
                seen, size = seen + 1, size + len(content)
                if seen > most_members or size > most_bytes:
                    yield chain, member, None, "limit_reached"
                    return
                if archive_like(member, content[:8]):
                    if len(chain) >= most_depth:
                        yield chain, member, None, "too_deep"
                    else:
                        todo.append(([*chain, member.rpartition("/")[2]], content))
                else:
                    yield chain, member, content, ""
            if empty:
                yield chain, "", None, "empty_archive"
        except TooLarge:
            yield chain, "", None, "limit_reached"
            return
        except _BROKEN as error:
            yield chain, "", None, f"bad_archive:{type(error).__name__}"


def explode(files: DataFrame, most_depth: int = 8, most_members: int = 100_000, most_bytes: int = 2 << 30) -> DataFrame:
    """One row per member of the archives in ``files`` (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, held = [], 0
                for k, (chain, member, content, note) in enumerate(walk(path, raw or b"", most_depth, most_members, most_bytes)):
                    rows.append((path, chain, member, k, None if content is None else len(content), content, note))
                    held += len(content or b"")
                    if held > 32 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, "archive_source string, archive_chain array<string>, member string, pos bigint, size bigint, content binary, note string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = ["archive_source", "archive_chain", "member", "pos", "size", "content", "note"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def with_members(files: DataFrame, **limits: int) -> DataFrame:
    """Files with the members of archives in their place: path, archive_chain, archive_source, ..."""
    from quire.functions.content import is_archive

    marked = files.withColumn("__a", is_archive(F.col("path"), F.col("content"), F.lit(None).cast("string")))
    plain = marked.where("not __a").select("path", F.array().cast("array<string>").alias("archive_chain"), F.lit(None).cast("string").alias("archive_source"), "size_bytes", "content", F.lit("").alias("note"))
    inner = explode(marked.where("__a"), **limits)
    inner = inner.select(F.concat_ws("/", "archive_source", "member").alias("path"), "archive_chain", "archive_source", F.coalesce("size", F.lit(0)).alias("size_bytes"), "content", "note")
    return plain.unionByName(inner)
