"""Removal of long repeated passages with a run-length compressed suffix index.

1. Equal texts become one class; of a text held twice every byte is repeated.
2. Windows are the strings of ``span`` bytes, and those of ``words`` whole words that are shorter. Each
   names as its anchor the place of the least hash of ``GRAM`` bytes in it. Equal windows name
   equal anchors, so a window can only repeat where an anchor does.
3. The windows of repeated anchors go by anchor to blocks of bounded size. Pieces of a hot anchor
   that are equal become one; what differs is cut into parts that meet pairwise, so no block gathers
   a whole group.
4. A block's passages are sorted into a suffix array; its Burrows-Wheeler transform is run-length
   compressed, and the matching statistics are streamed from the sampled run ends: a match inside
   a run is the tail of the match one byte to the left, so the matches at run ends, at full
   length, cover all others. Matches of ``span`` bytes or more are marked at both places. Windows of
   words that lie in a match are compared by digest, each with all others of the block.
5. Marks are joined by document and the bytes cut. Maximal runs of marks of either kind that hold ``words`` whole
   words (bytes between white space) or more are passages: they tell of a repeat that is
   long in words but may be too short in bytes to be removed.

Defined results: null counts as the empty text; texts under ``span`` bytes keep all bytes, and
those under ``words`` words hold no passage; a passage that overlaps its own copy is marked; repeated rows are copies of each other; an empty
table gives no rows; other columns are ignored. Memory and time of a task grow with the longest text
that repeats itself throughout, as its pieces are one passage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import TextBatch, lean, mix64, small_batches, table, written

GRAM = 64
BLOCK = 2 << 20
_BYTE = mix64(np.arange(1000, 1256, dtype=np.uint64))
_STEP = 0x9D8A7B6C5F4E3D21
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, made by doubling."""
    h, span, factor = _BYTE[data], 1, _STEP
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:] if len(h) > span else h[:0]
        factor, span = factor * factor % (1 << 64), span * 2
    return mix64(h)


def window_anchors(h: np.ndarray, width: int, starts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost place of the least hash among ``width`` places from each position on, and in further ranges.

    ``widths`` of the ranges from ``starts`` on are at most ``width``. A range is covered by two of the
    next lower power of two.
    """
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    out = np.zeros(len(starts), np.uint64)
    have = 1
    while True:
        own = (widths >= have) & (widths < 2 * have)
        out[own] = np.minimum(key[starts[own]], key[starts[own] + widths[own] - have])
        if have * 2 > width or len(key) <= have:
            break
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    every = np.minimum(key[: len(key) - rest], key[rest:]) if have * 2 > width and len(key) > rest else key[:0]
    low = np.uint64(0xFFFFFFFF)
    return (every & low).astype(np.int64), (out & low).astype(np.int64)


def word_windows(data: np.ndarray, ends: np.ndarray, words: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the strings of ``words`` whole words and under ``span`` bytes, each within a row."""
    inside = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins = inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1]))
    stops = inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if len(begins) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = begins[: len(begins) - words + 1], stops[words - 1 :]
    row = np.searchsorted(ends, a, side="right")
    fits = (b - a < span) & (b - a >= GRAM) & (b <= ends[row])
    return a[fits], b[fits]


def anchors(texts: TextBatch, a: int, b: int, span: int, words: int) -> tuple[np.ndarray, ...]:
    """(row, hash, first window, last window, anchors) of rows a..b, merged by hash.

    Windows of one anchor hash less than ``span`` bytes apart within a row are one entry.
    """
    base, ends = texts.bounds[a], texts.bounds[a : b + 1] - texts.bounds[a]
    data = texts.bytes[base : texts.bounds[b]]
    empty = np.zeros(0, np.int64)
    h = gram_hashes(data)
    first, stop = word_windows(data, ends, words, span) if len(h) else (empty, empty)
    at, own = window_anchors(h, span - GRAM + 1, first, stop - first - GRAM + 1)
    row = np.searchsorted(ends, np.arange(len(at)), side="right") - 1
    start = np.flatnonzero(np.arange(len(at)) + span <= ends[row + 1]) if len(at) else empty
    start, place = np.concatenate((start, first)), np.concatenate((at[start], own))
    if not len(start):
        return empty, empty, empty, empty, empty
    # windows by anchor; a place lies in one row
    order = np.argsort(place, kind="stable")
    place, start = place[order], start[order]
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    lo, hi, place = np.minimum.reduceat(start, head), np.maximum.reduceat(start, head), place[head]
    who, name = np.searchsorted(ends, place, side="right") - 1, h[place].view(np.int64)
    order = np.lexsort((lo, name, who))
    lo, hi, who, name = lo[order], hi[order], who[order], name[order]
    new = np.ones(len(lo), bool)
    new[1:] = (who[1:] != who[:-1]) | (name[1:] != name[:-1]) | (lo[1:] > hi[:-1] + span)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return who[first], name[first], lo[first] - ends[who[first]], hi[last] - ends[who[first]], last - first + 1


def word_counts(texts: TextBatch, a: int, b: int) -> np.ndarray:
    """Number of words of each row a..b."""
    ends = texts.bounds[a : b + 1] - texts.bounds[a]
    inside = ~_SPACES[texts.bytes[texts.bounds[a] : texts.bounds[b]]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(inside)]
    begins[first] = inside[first]
    return np.diff(np.concatenate(([0], np.cumsum(begins)))[ends])


def whole_words(body: bytes, a: int, b: int) -> int:
    """Number of words that lie in body[a:b] from end to end."""
    found = [m.span() for m in _WORD.finditer(body, max(0, a - 1), b + 1)]
    return sum(x >= a and y <= b for x, y in found)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling over the suffixes that are still tied.

    ``text`` holds symbols from 1 on and 0 at the end of each passage (the last one included);
    ends differ from each other, in order of place.
    """
    n, wide = len(text), 7
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    ended = np.zeros(n, bool)
    for k in range(wide):
        symbol = np.zeros(n, np.uint64)
        symbol[: n - k] = text[k:]
        key = key << np.uint64(9) | np.where(alive, symbol, 0)
        ended |= alive & (symbol == 0)
        alive &= symbol != 0
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.ones(n, bool)
    head[1:] = (ordered[1:] != ordered[:-1]) | ended[order][1:]  # an end is unlike all others
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = ~(head & np.append(head[1:], True))
    active = order[tied]
    while len(active):
        both = rank[active] << 32 | rank[np.minimum(active + wide, n - 1)]
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        old = both >> 32
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        head = np.ones(len(active), bool)
        head[1:] = both[1:] != both[:-1]
        at = np.arange(len(active))
        now = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = now
        active = active[~(head & np.append(head[1:], True))]
        wide *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def run_ends(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled run ends of the run-length Burrows-Wheeler transform: neighbours across each seam."""
    before = np.where(order > 0, text[order - 1], 0)
    seam = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
    return order[seam], order[seam - 1]


def match_lengths(text: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common passage from p and q on, up to the end of either passage."""
    n, length = len(text), np.zeros(len(p), np.int64)
    packed = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    for k in range(7):
        packed[: n - k] = packed[: n - k] << np.uint64(9) | text[k:].astype(np.uint64)
        whole[: n - k] &= text[k:] != 0
    whole[max(0, n - 6) :] = False
    for seven in (True, False):
        alive = np.arange(len(p))
        while len(alive):
            i, j = p[alive] + length[alive], q[alive] + length[alive]
            same = (packed[i] == packed[j]) & whole[i] & whole[j] if seven else (text[i] == text[j]) & (text[i] != 0)
            alive = alive[same]
            length[alive] += 7 if seven else 1
    return length


def repeated(passages: list[bytes], span: int) -> list[np.ndarray]:
    """For each passage, whether each byte lies in a match of ``span`` bytes with another place."""
    lengths = np.fromiter(map(len, passages), np.int64, len(passages))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    text = np.zeros(int(starts[-1]), np.int16)
    inside = np.ones(len(text), bool)
    inside[starts[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(passages), np.uint8).astype(np.int16) + 1
    p, q = run_ends(text, suffix_array(text))
    length = match_lengths(text, p, q)
    far = length >= span
    edge = np.zeros(len(text) + 1, np.int64)
    for at in (p[far], q[far]):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length[far], -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [covered[s : s + n] for s, n in zip(starts[:-1].tolist(), lengths.tolist(), strict=True)]


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


Passage = tuple[int, int, int, bytes, bytes]


def range_digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, factor: int) -> np.ndarray:
    """Hash of the bytes in each range, whatever its place."""
    n = len(data) + 1
    up, down = np.full(n, np.uint64(factor)), np.full(n, np.uint64(pow(factor, -1, 1 << 64)))
    up[0] = down[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * np.multiply.accumulate(up)[:-1])))
    return mix64((sums[stops] - sums[starts]) * np.multiply.accumulate(down)[starts]) + (stops - starts).astype(np.uint64)


def repeated_windows(rows: list[Passage]) -> Iterator[tuple[int, int, int, int, bool]]:
    """Runs of the windows in ``rows`` (sorted by owner) that stand at two places or more, by digests of 128 bits."""
    owner, texts = {}, np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    base = np.cumsum([0] + [len(r[3]) for r in rows[:-1]])
    windows = [np.frombuffer(r[4], np.int32).reshape(-1, 2).astype(np.int64) for r in rows]
    size = [len(w) for w in windows]
    if not sum(size):
        return
    pairs = np.concatenate(windows)
    at = np.repeat(base, size)
    who = np.repeat([owner.setdefault(r[:2], len(owner)) for r in rows], size)
    place = pairs[:, 0] + np.repeat([r[2] for r in rows], size)
    one, two = (range_digests(texts, pairs[:, 0] + at, pairs[:, 1] + at, f) for f in (_STEP, 0xD1342543DE82EF95))
    order = np.lexsort((place, who, two, one))
    one, two, who, place, length = one[order], two[order], who[order], place[order], (pairs[:, 1] - pairs[:, 0])[order]
    head = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    last = np.append(head[1:], len(one)) - 1
    twice = np.repeat((who[head] != who[last]) | (place[head] != place[last]), last - head + 1)
    who, a, b = who[twice], place[twice], (place + length)[twice]
    order = np.lexsort((a, who))
    who, a, b = who[order], a[order], b[order]
    # windows of one owner end in the order of their starts
    new = np.ones(len(a), bool)
    new[1:] = (who[1:] != who[:-1]) | (a[1:] > b[:-1])
    head = np.flatnonzero(new)
    names = list(owner)
    for k, x, y in zip(who[head].tolist(), a[head].tolist(), b[np.append(head[1:], len(a))[: len(head)] - 1].tolist(), strict=True):
        yield *names[k], x, y, False


def block_spans(rows: list[Passage], span: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """Repeated (x1, x2, start, end, wide) of one block's passages (x1, x2, start, body, windows).

    Wide runs are covered by matches of ``span`` bytes, the others by windows of words; ``windows``
    holds starts and stops of a passage's windows within its body.
    """
    rows = sorted(rows)
    joined: list[tuple[int, int, int, bytes]] = []
    for x1, x2, start, body, _ in rows:
        if joined and joined[-1][:2] == (x1, x2) and start <= joined[-1][2] + len(joined[-1][3]):
            _, _, s, have = joined[-1]
            joined[-1] = (x1, x2, s, have + body[max(0, s + len(have) - start) :])
        else:
            joined.append((x1, x2, start, body))
    yield from repeated_windows(rows)
    owners: dict[bytes, list[int]] = {}
    for k, row in enumerate(joined):
        owners.setdefault(row[3], []).append(k)
    bodies = list(owners)
    for body, marks in zip(bodies, repeated(bodies, span), strict=True):
        twice = len(owners[body]) > 1 and len(body) >= span  # the same passage at two places or more
        runs = [(0, len(body))] if twice else list(zip(*(x.tolist() for x in _runs(marks)), strict=True))
        for k in owners[body]:
            x1, x2, start, _ = joined[k]
            for a, b in runs:
                yield x1, x2, start + a, start + b, True


def find_repeats(docs: DataFrame, span: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int = 51) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, spans, passages.

    ``spans`` are the runs that ``n_removed`` counts. ``passages`` are the maximal runs, with ``words``
    words or more, that are covered by strings which also start anywhere else: strings of ``span``
    bytes, or of ``words`` whole words with GRAM to ``span`` bytes, whole at both places.
    """
    if span < GRAM:
        raise ValueError(f"span must be {GRAM} or more")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(span), text).alias("x2"), text.alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = TextBatch(batch.column("text"))
            for a, b in texts.groups(1 << 20):
                who, name, lo, hi, count = anchors(texts, a, b, span, words)
                ends = pa.array(np.searchsorted(who, np.arange(b - a + 1)).astype(np.int32))
                shas = [hashlib.sha256(texts.text(i)).hexdigest() for i in range(a, b)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (name, lo.astype(np.int32), hi.astype(np.int32), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "x1", "x2")), pa.array(np.diff(texts.bounds[a : b + 1])), pa.array(word_counts(texts, a, b)), pa.array(shas, pa.string()), *lists], names=["doc_id", "x1", "x2", "n_bytes", "n_words", "sha", "h", "lo", "hi", "c"])

    rows = written(source.mapInArrow(lean(scan), f"doc_id {id_type}, x1 long, x2 long, n_bytes long, n_words long, sha string, h array<long>, lo array<int>, hi array<int>, c array<int>"), "repeat-rows")
    classes = rows.groupBy("x1", "x2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("owner"), *(F.first(c).alias(c) for c in ("h", "lo", "hi", "c")))
    classes = written(classes, "repeat-classes")
    entries = classes.select("x1", "x2", "owner", F.explode(F.arrays_zip("h", "lo", "hi", "c")).alias("e")).select("x1", "x2", "owner", "e.*")
    size = F.col("hi") - F.col("lo") + span
    often = entries.groupBy("h").agg(F.sum("c").alias("n"), F.sum(size).alias("bytes")).where("n > 1").select("h", (F.col("bytes") > BLOCK // 2).alias("hot"))
    wanted = written(entries.join(often, "h"), "repeat-wanted")
    total = wanted.agg(F.sum(size)).first()[0] or 0
    blocks = total // BLOCK + 1
    # a text's own entries only: bounded by its length
    needs = wanted.groupBy("x1", "x2", "owner").agg(F.collect_list(F.struct("h", "lo", "hi", "hot")).alias("e"))
    needs = needs.withColumnsRenamed({"x1": "y1", "x2": "y2"})
    texts = source.join(needs, (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")) & F.col("doc_id").eqNullSafe(F.col("owner"))).select("x1", "x2", "text", "e")
    texts = written(texts, "repeat-texts")

    def cut(hot: bool):
        """Pieces of the texts: those of hot anchors under their digest, the others under their block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                views = TextBatch(batch.column("text"))
                x1s, x2s, es = (batch.column(c).to_pylist() for c in ("x1", "x2", "e"))
                out: list[list] = [[] for _ in range(7)]
                held = 0
                for i, (x1, x2, entry) in enumerate(zip(x1s, x2s, es, strict=True)):
                    body = views.text(i)
                    own = [e for e in entry if e["hot"] == hot]
                    if not own:
                        continue
                    data = np.frombuffer(body, np.uint8)
                    first, stop = word_windows(data, np.array([0, len(body)]), words, span)
                    for e in own:
                        lo, hi = e["lo"], e["hi"]
                        piece = body[lo : hi + span]
                        a, b = np.searchsorted(first, lo), np.searchsorted(first, hi, side="right")
                        windows = np.stack((first[a:b], stop[a:b]), axis=1) - lo
                        key = (e["h"], 0) if hot else (e["h"] % blocks, 0)
                        for column, value in zip(out, (*key, x1, x2, lo, piece, windows.astype(np.int32).tobytes()), strict=True):
                            column.append(value)
                        held += len(piece)
                    if held > 4 << 20:
                        yield _passages(out)
                        out, held = [[] for _ in range(7)], 0
                yield _passages(out)

        return lean(run)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = (0, 0), []

        def due() -> bool:
            # one passage can repeat within itself: worked in a cell of its own part, not again in cells of two
            return len(held) > 1 or (len(held) == 1 and key[1] <= 0)

        def work() -> pa.RecordBatch:
            found = list(zip(*block_spans(held, span), strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found[:4]), pa.array(found[4], pa.bool_())], names=["x1", "x2", "start", "stop", "wide"])

        names = ("k1", "k2", "x1", "x2", "start", "body", "windows")
        for batch in batches:
            for k1, k2, *passage in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (k1, k2) != key:
                    if held and due():
                        yield work()
                    key, held = (k1, k2), []
                held.append(tuple(passage))
        if held and due():
            yield work()

    passage = "k1 long, k2 long, x1 long, x2 long, start long, body binary, windows binary"
    found = "x1 long, x2 long, start long, stop long, wide boolean"
    worked = lambda rows: rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(lean(mark), found)
    spans = worked(texts.mapInArrow(cut(False), passage))
    # hot anchors: equal pieces are one, and the parts of different ones meet pairwise
    pieces = texts.mapInArrow(cut(True), passage).select("k1", F.xxhash64("body").alias("d1"), F.xxhash64(F.lit(span), "body").alias("d2"), "x1", "x2", "start", "body", "windows")
    pieces = written(pieces, "repeat-pieces")
    same = ["k1", "d1", "d2"]
    apart = written(pieces.groupBy(*same).agg(F.count("*").alias("copies"), F.first("body").alias("body"), F.first("windows").alias("windows")), "repeat-apart")
    parts = written(apart.groupBy("k1").agg(F.ceil(F.sum(F.octet_length("body")) / (BLOCK // 2)).cast("int").alias("parts")), "repeat-parts")
    own = F.pmod("d1", "parts")
    # a part's own cell is told by a negative number
    cell = F.when(F.col("k") == F.col("own"), -1 - F.col("own")).otherwise(F.least("own", "k") * F.col("parts") + F.greatest("own", "k"))
    dealt = apart.join(parts, "k1").withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("k1", cell.cast("long").alias("k2"), F.col("d1").alias("x1"), F.col("d2").alias("x2"), F.lit(0).cast("long").alias("start"), "body", "windows")
    apart_spans = worked(dealt)
    # of pieces that stand several times, all bytes and all windows are repeats
    whole = apart.where("copies > 1").select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), "body", "windows").mapInArrow(lean(_all_of(span)), found)
    told = written(apart_spans.union(whole).distinct(), "repeat-hot").withColumnsRenamed({"x1": "d1", "x2": "d2", "start": "a", "stop": "b"})
    members = pieces.select("d1", "d2", "x1", "x2", "start").distinct()
    hot_spans = members.join(told, ["d1", "d2"]).select("x1", "x2", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"), "wide")
    spans = spans.union(hot_spans)
    spans = written(spans.distinct(), "repeat-spans").groupBy("x1", "x2").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "wide"))).alias("s"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = TextBatch(batch.column("text"))
            removed, count, shas, merged, passages = [], [], [], [], []
            for i, found in enumerate(batch.column("s").to_pylist()):
                body, kept, last = views.text(i), hashlib.sha256(), 0
                runs = _merged((f["start"], f["stop"]) for f in found if f["wide"])
                for a, b in runs:
                    kept.update(body[last:a])
                    last = b
                kept.update(body[last:])
                removed.append(sum(b - a for a, b in runs))
                count.append(len(runs))
                shas.append(kept.hexdigest())
                merged.append(runs)
                passages.append([r for r in _merged((f["start"], f["stop"]) for f in found) if whole_words(body, *r) >= words])
            lists = (pa.array(x, pa.list_(pa.list_(pa.int64()))) for x in (merged, passages))
            yield pa.RecordBatch.from_arrays([batch.column("x1"), batch.column("x2"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(shas, pa.string()), *lists], names=["x1", "x2", "removed", "count", "kept", "runs", "long"])

    cuts = texts.select("x1", "x2", "text").join(spans, ["x1", "x2"]).mapInArrow(lean(remove), "x1 long, x2 long, removed long, count long, kept string, runs array<array<long>>, long array<array<long>>")
    # a class with two owners of one id would give its row twice
    cuts = cuts.groupBy("x1", "x2").agg(*(F.first(c).alias(c) for c in ("removed", "count", "kept", "runs", "long")))
    by_class = written(classes.select("x1", "x2", "copies").join(cuts, ["x1", "x2"], "left"), "repeat-cuts")
    twice = F.col("copies") > 1
    whole = twice & (F.col("n_bytes") >= span)
    told = twice & (F.col("n_bytes") >= GRAM) & (F.col("n_words") >= words)
    nothing = hashlib.sha256(b"").hexdigest()
    none = F.array().cast("array<array<bigint>>")
    all_bytes = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    return rows.select("doc_id", "x1", "x2", "n_bytes", "n_words", "sha").join(by_class, ["x1", "x2"]).select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("count", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(told, 1).otherwise(F.coalesce(F.size("long"), F.lit(0))).cast("long").alias("n_passages"),
        F.when(whole, all_bytes).otherwise(F.coalesce("runs", none)).alias("spans"),
        F.when(told, all_bytes).otherwise(F.coalesce("long", none)).alias("passages"),
    )


def _merged(runs: Iterator[tuple[int, int]]) -> list[list[int]]:
    """Sorted runs, those that meet or overlap joined."""
    out: list[list[int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _all_of(span: int):
    """Spans of pieces that stand at several places: all bytes, if enough, and all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x1, x2, body, packed in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "body", "windows")), strict=True):
                out += [(x1, x2, 0, len(body), True)] if len(body) >= span else []
                out += [(x1, x2, a, b, False) for a, b in _merged(iter(np.frombuffer(packed, np.int32).reshape(-1, 2).tolist()))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.bool_())], names=["x1", "x2", "start", "stop", "wide"])

    return run


def _passages(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["k1", "k2", "x1", "x2", "start", "body", "windows"])


def op10_rindex_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents")).drop("spans", "passages")
