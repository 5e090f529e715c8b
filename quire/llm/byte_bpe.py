"""Byte-level BPE encoding and decoding over length-bucketed matrices.

Every distinct pre-token of a batch becomes one row of a padded matrix whose width fits its
length bucket. In each round every row finds the rank of each neighbouring pair by a hashed
lookup, merges its leftmost pair of least rank, and closes the gap; finished rows leave the
matrix. Encoded pre-tokens are kept in caches bounded in bytes, so common words are merged once.

Defined results: null text counts as empty and gives no ids; an empty id list decodes to no
bytes; repeated rows each give their own row; ids that are not in the vocabulary raise.
Pre-tokens over ``LONG`` bytes follow the same rule through a heap of pairs: a matrix would need
quadratic time for them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import lean, small_batches, table

NO_RANK = np.int32(1 << 30)
LONG = 512
BUCKETS = (4, 8, 16, 32, 64, 128, 256, LONG)
#: Bytes of each of a codec's two caches, and of text that is worked at a time.
CACHE, GROUP = 40 << 20, 1 << 20
#: What a cache entry takes besides the characters and ids: two objects and a place in a dict.
ENTRY = 180


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """``base64 rank`` lines of a rank file."""
    ranks = {}
    for line in lines:
        if parts := line.split():
            ranks[base64.b64decode(parts[0])] = int(parts[1])
    return ranks


def _gap(part: str) -> bool:
    """Whether a space beside this part may belong to a longer run of white space."""
    return not part or part[0].isspace() or part[-1].isspace()


class PairTable:
    """Open-addressing table from a pair of ids to the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        todo = np.fromiter(pairs.keys(), np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.values[slot[put]] = todo[put], vals[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, vals, slot = todo[rest], vals[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], NO_RANK)
        more = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[more]]
            hit = found == key[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


class Recent(dict):
    """Encoded strings of two generations: what was not used for a whole one is forgotten."""

    def __init__(self, most: int):
        self.most, self.size, self.old = most // 2, 0, {}

    def keep(self, found: dict[str, bytes]) -> None:
        self.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def lacks(self, words: set[str]) -> set[str]:
        """Those of ``words`` that neither generation has; the old one's are taken over."""
        rest = words.difference(self)
        if self.old:
            self.keep({w: self.old[w] for w in rest & self.old.keys()})
            rest.difference_update(self)
        return rest

    def age(self) -> None:
        """To be called between groups, when nothing is being looked up."""
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0


class ByteBpe:
    """Codec for one rank table and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if len(ranks) and self.single.min() < 0:
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.cache, self.spaced = Recent(CACHE), Recent(CACHE)

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = np.full((n, width), NO_RANK, np.int32)  # rank of columns c and c + 1
        r, c = np.nonzero(ids[:, 1:] >= 0)
        pair[r, c] = self.pairs.look(ids[r, c], ids[r, c + 1])
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        while len(rows):
            at = pair.argmin(axis=1)
            rank = pair[np.arange(len(rows)), at]
            done = rank == NO_RANK
            if done.any():
                ended = ids[done]
                stop = np.cumsum((ended >= 0).sum(axis=1)) * 4
                flat, start = ended[ended >= 0].astype("<u4").tobytes(), 0
                for k, end in zip(rows[done].tolist(), stop.tolist(), strict=True):
                    out[k] = flat[start:end]
                    start = end
                go = ~done
                ids, pair, rows, at, rank = ids[go], pair[go], rows[go], at[go], rank[go]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            shifted = np.arange(width - 1) > at[:, None]  # close the gap right of the merged pair
            ids[:, :-1] = np.where(shifted, ids[:, 1:], ids[:, :-1])
            pair[:, :-1] = np.where(np.arange(width - 1) >= at[:, None], pair[:, 1:], pair[:, :-1])
            ids[:, -1], pair[:, -1] = -1, NO_RANK
            ids[every, at] = rank
            right = np.minimum(at + 1, width - 1)
            has = (at + 1 < width) & (ids[every, right] >= 0)
            pair[every, at] = NO_RANK
            pair[every[has], at[has]] = self.pairs.look(rank[has], ids[every[has], right[has]])
            has = at > 0
            pair[every[has], at[has] - 1] = self.pairs.look(ids[every[has], at[has] - 1], rank[has])
            width -= 1
            ids, pair = ids[:, :width], pair[:, :width]
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        join = lambda i, j: self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[j]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := join(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := join(i, k)) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := join(h, i)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int64)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the given distinct pre-tokens into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        found: dict[str, bytes] = {}
        for word in words:
            raw = word.encode("utf-8")
            if (whole := self.ranks.get(raw)) is not None:
                found[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                found[word] = self._heap(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault(next(b for b in BUCKETS if len(raw) <= b), []).append((word, raw))
        for width, both in buckets.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(both), step):
                part = both[k : k + step]
                found.update(zip([word for word, _ in part], self._matrix([raw for _, raw in part], width), strict=True))
        self.cache.keep(found)

    def encode_bytes(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, in order; GROUP characters or one text at a time.

        No pre-token spans a single space between two characters that are not white space, so
        most texts are looked up by the parts between spaces; texts with other gaps are split
        as a whole.
        """
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text or "") > GROUP:
                yield from self._encode(group)
                group, held = [], 0
            group.append(text or "")
            held += len(group[-1])
        yield from self._encode(group)

    def _encode(self, group: list[str]) -> Iterator[bytes]:
        self.cache.age()
        self.spaced.age()
        parts = [t.split(" ") for t in group]
        fresh = self.spaced.lacks(set().union(*parts))
        gaps = {p for p in fresh if _gap(p)}
        new = {p: self.split.findall(" " + p) for p in fresh - gaps}
        plain = [not _gap(p[0]) and gaps.isdisjoint(p) for p in parts]
        whole = [self.split.findall(p[0] if ok else t) for t, p, ok in zip(group, parts, plain, strict=True)]
        self.learn(self.cache.lacks(set().union(*new.values(), *whole)))
        get, known = self.cache.__getitem__, self.spaced.__getitem__
        self.spaced.keep({p: b"".join(map(get, words)) for p, words in new.items()})
        for p, ok, words in zip(parts, plain, whole, strict=True):
            yield b"".join(map(get, words)) + (b"".join(map(known, p[1:])) if ok else b"")

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Read a rank file (a vocabulary: bounded) on the driver, from a local path or through Spark."""
    if "://" in path:
        return parse_ranks(r[0].encode() for r in spark.read.text(path).collect())
    with open(path, "rb") as lines:
        return parse_ranks(lines)


def tokenize(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode each row: id, n_tokens, ids_sha256, decoded_sha256 and the ids.

    One narrow pass over the text without a shuffle; the rank table (bounded by the vocabulary)
    is broadcast. ``keep_ids`` adds column ``ids`` as little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe(shared.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, ids_hash, text_hash, kept = [], [], [], []
                for ids in codec.encode_bytes(part.column("text").to_pylist()):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
                    kept.append(ids if keep_ids else b"")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())] + [pa.array(kept, pa.binary())] * keep_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return source.mapInArrow(lean(run), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tokenize(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)
