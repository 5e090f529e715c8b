"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last WINDOW bytes rolls over the text; where it ends in k ones or more, a chunk of
expected size 2^k ends. Each chunk gives one character of its hash, so an edit changes only the
characters near it. The fingerprint ``<block size>:<chunks>:<chunks>:<chunks>`` has the signatures
at the block size and at twice and four times of it; the block size is the largest power of two that
leaves LEAST chunks or more and no more than about LONGEST. Signatures at a common block size are
compared by edit distance: likeness is 1 - distance / length of the longer one, and 0 if they have no
common run of COMMON characters. Without a common block size it is 0; equal fingerprints give 1.

``edited`` reads the rows in descending order of id, dealt out by ranges of it: a task sees each row
beside its next. The last row of a range meets the first of the next range in a second, small step.

Defined results: null is the empty text, whose fingerprint is ``1:::`` and has likeness 1 with itself
and 0 with any other; rows in descending order of id, null ids last, rows that repeat an id by a
hash of their texts, rows equal in both in any order (it makes no difference); a single row is its
own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import lean, mix64, small_batches, table, written

WINDOW = 8
LEAST, LONGEST, COMMON = 32, 64, 4
LEVELS = 3
#: Bytes worked at a time, so that the memory of a long text is bounded by a few bytes for each of its own.
SEGMENT = 1 << 20
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(LETTERS, np.uint8)
_BYTE = mix64(np.arange(3000, 3256, dtype=np.uint64))
_ROLL, _CHUNK = 0x9E6C63D0876A9A47, 0x2545F4914F6CDD1D


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_WEIGHTS = _powers(_CHUNK, SEGMENT)
_BACK = pow(_CHUNK, -1, 1 << 64)
_UNWEIGHTS = _powers(_BACK, SEGMENT)


def levels(data: np.ndarray) -> np.ndarray:
    """For each byte how many ones the hash of the WINDOW bytes up to it ends in; 0 before a whole window."""
    out = np.zeros(len(data), np.uint8)
    for start in range(0, len(data), SEGMENT):
        h, span, factor = _BYTE[data[max(0, start - WINDOW + 1) : start + SEGMENT]], 1, _ROLL
        while span < WINDOW:  # by doubling
            h = h[:-span] * np.uint64(factor) + h[span:] if len(h) > span else h[:0]
            factor, span = factor * factor % (1 << 64), span * 2
        if len(h):
            low = mix64(h)
            stop = min(start + SEGMENT, len(data))
            out[stop - len(h) : stop] = np.bitwise_count(low & ~(low + np.uint64(1)))
    return out


def _sums(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the weighted bytes before each (rising) place."""
    out, carry, k = np.zeros(len(at), np.uint64), np.uint64(0), 0
    for a in range(0, len(data), SEGMENT):
        part = data[a : a + SEGMENT]
        running = np.cumsum(_BYTE[part] * (_WEIGHTS[: len(part)] * np.uint64(pow(_CHUNK, a, 1 << 64)))) + carry
        stop = int(np.searchsorted(at, a + len(part), side="right"))
        inner = at[k:stop] - a
        out[k:stop] = np.where(inner > 0, running[inner - 1], carry)
        carry, k = running[-1], stop
    return out


def _unweighted(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums as if their chunk had begun at place 0."""
    far = [pow(_BACK, int(a) * SEGMENT, 1 << 64) for a in range(int(starts.max(initial=0)) // SEGMENT + 1)]
    return sums * _UNWEIGHTS[starts % SEGMENT] * np.array(far, np.uint64)[starts // SEGMENT]


def group_fingerprints(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Fingerprints of the texts between ``bounds`` of ``data``."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    level = levels(data)
    for j in range(WINDOW - 1):  # no window reaches over the start of a text
        level[(bounds[:-1] + j)[sizes > j]] = 0
    owner = np.repeat(np.arange(n), sizes)
    # boundaries of each text at each level or above
    top = int(level.max(initial=0)) + 1
    counts = np.bincount(owner * top + level, minlength=n * top).reshape(n, top)[:, ::-1].cumsum(axis=1)[:, ::-1]
    k = np.zeros(n, np.int64)
    while (small := LONGEST << k < sizes).any():
        k += small
    at = lambda k: np.where(k < top, counts[np.arange(n), np.minimum(k, top - 1)], 0)
    while (few := (k > 0) & (at(k) + 1 < LEAST)).any():
        k -= few
    signatures = []
    for j in range(LEVELS):
        ends = np.flatnonzero(level >= np.minimum(k + j, 255).astype(np.uint8)[owner])
        ends = ends[ends + 1 < bounds[owner[ends] + 1]]  # the end of a text ends its last chunk
        turn = np.arange(len(ends)) - np.searchsorted(ends, bounds[:-1])[owner[ends]]
        starts = np.sort(np.concatenate((bounds[:-1][sizes > 0], ends[turn < LONGEST - 1] + 1)))
        of = owner[starts]
        sums = _sums(data, np.append(starts, len(data)))
        letters = _LETTERS[(mix64(_unweighted(sums[1:] - sums[:-1], starts)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
        cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
        signatures.append([letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    return [":".join(x) for x in zip(map(str, (1 << k).tolist()), *signatures, strict=True)]


def fingerprints_of(texts: list[bytes]) -> list[str]:
    """Fingerprints of ``texts``, worked in groups of about a segment."""
    out: list[str] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SEGMENT):
            size, b = size + len(texts[b]), b + 1
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts[a:b]]))).astype(np.int64)
        out += group_fingerprints(np.frombuffer(b"".join(texts[a:b]), np.uint8), bounds)
        a = b
    return out


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between ``a`` and ``b``, by bit-parallel columns."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top, up, down, distance = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        cross = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(cross | up)), up & cross
        distance += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~((same | down) | more)), more & (same | down)
    return distance


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1, at the least block size that both have."""
    if a == b:
        return 1.0
    (size_a, *one), (size_b, *two) = a.split(":"), b.split(":")
    sizes = [{int(size) << j: s for j, s in enumerate(x)} for size, x in ((size_a, one), (size_b, two))]
    common = sorted(sizes[0].keys() & sizes[1].keys())
    if not common:
        return 0.0
    x, y = sizes[0][common[0]], sizes[1][common[0]]
    run = min(COMMON, len(x), len(y))
    if not run or not {x[k : k + run] for k in range(len(x) - run + 1)} & {y[k : k + run] for k in range(len(y) - run + 1)}:
        return 0.0
    return 1.0 - edit_distance(x, y) / max(len(x), len(y))


def edit(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first as many characters of ``after``."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _told(texts: list[str], marks: list[str]) -> list[tuple]:
    """For each text but the last, beside its next: n_chars, sha, its fingerprint and the edited text's, likenesses."""
    changed = [edit(text, after).encode() for text, after in zip(texts, texts[1:], strict=False)]
    out = zip(texts, marks, marks[1:], changed, fingerprints_of(changed), strict=False)
    return [(len(text), hashlib.sha256(new).digest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, after)) for text, mark, after, new, new_mark in out]


_TOLD = "n_chars long, sha binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [c.split()[0] for c in _TOLD.split(", ")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row for each document; no shuffle."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints_of([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    # the place only deals out rows that are equal in id and text
    keys = [F.desc_nulls_last("doc_id"), F.col("h"), F.col("place")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row but a range's last beside its next; texts of its first and last row go on."""
        part, nothing = TaskContext.get().partitionId(), (None,) * len(_NAMES)
        ids, texts, marks, first = [], [], [], True

        def record(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, *_KINDS, pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", *_NAMES, "part", "first", "last"])

        for batch in batches:
            kind, new = batch.schema.field("doc_id").type, batch.column("text").to_pylist()
            if not new:
                continue
            # the row that still waits for its next goes before the new ones
            ids, texts, marks = ids[-1:] + batch.column("doc_id").to_pylist(), texts[-1:] + new, marks[-1:] + fingerprints_of([t.encode() for t in new])
            rows = [(i, *x, None, None, None) for i, x in zip(ids, _told(texts, marks), strict=False)]
            if first:
                rows, first = [(None, *nothing, part, texts[0], None), *rows], False
            if rows:
                yield record(rows, kind)
        if texts:
            yield record([(ids[-1], *nothing, part, None, texts[-1])], kind)

    found = written(dealt.mapInArrow(lean(run), f"doc_id {id_type}, {_TOLD}, part int, first string, last string"), "edits")
    whole = found.where("part is null").select("doc_id", *_NAMES)
    # a row for each range that has rows: the next range's number goes beside each
    parts = sorted(r["part"] for r in found.where("first is not null").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    firsts = found.where("first is not null").select(F.col("part").alias("after"), "first")
    seams = found.where("last is not null").select("doc_id", "part", "last").join(F.broadcast(after), "part").join(firsts, "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("last").to_pylist(), batch.column("first").to_pylist(), strict=True)
            out = [x for a, b in pairs for x in _told([a, b], fingerprints_of([a.encode(), b.encode()]))]
            columns = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True))], names=["doc_id", *_NAMES])

    closed = seams.select("doc_id", "last", "first").mapInArrow(lean(close), f"doc_id {id_type}, {_TOLD}")
    return whole.union(closed).select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
