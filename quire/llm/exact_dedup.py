"""Exact deduplication by content-defined chunk recipes.

1. One pass cuts each normalised text where a rolling hash of its last bytes says so, names each
   chunk by a digest and gives the document its recipe: the ordered list of chunk names. A batch
   hands on each different chunk once.
2. Chunks are deduplicated by name *and* bytes. Two chunks of one name must be the same bytes;
   if any are not, the names are drawn again under another key, so recipes that agree are texts
   that agree. Chunk bytes move once; long texts themselves never do.
3. Documents are compared by recipe: grouped maxima and counts combined before the shuffle, then
   an equi-join on the recipe, which Spark may split where one group is hot.

Defined results: null counts as the empty text and all empty texts are equal; a null id is smaller
than any other; of rows that repeat both id and text, one is kept; empty tables give no rows;
other columns are ignored by ``find_copies`` and passed through by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import TextBatch, drop_marked, lean, mix64, small_batches, table, written

MASK = np.uint32(2047)
LEAST, MOST, WINDOW = 512, 16384, 16
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW bytes asks for a cut."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        wide = h.copy()
        wide[span:] += h[:-span] << np.uint32(span)
        h, span = wide, span * 2
    return np.flatnonzero((h >> np.uint32(12)) & MASK == 0) + 1


def recipe_bounds(start: int, stop: int, wanted: list[int]) -> list[int]:
    """Chunk ends of one text from its wanted cuts: at least LEAST and at most MOST bytes each."""
    ends, last = [], start
    for cut in [*wanted, stop]:
        if cut - last < LEAST and cut != stop:
            continue
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut > last:
            ends.append(cut)
            last = cut
    return ends


def _chunked(source: DataFrame, id_type: str, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = TextBatch(batch.column("text"))
            for a, b in texts.groups(1 << 20):
                base, top = int(texts.bounds[a]), int(texts.bounds[b])
                raw = texts.bytes[base:top]
                data = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
                lower = data.tobytes()
                cuts = cut_points(data)
                ends = (texts.bounds[a : b + 1] - base).tolist()
                # a window may reach into the text before: such cuts are not the text's own
                own = np.searchsorted(cuts, np.array(ends[:-1]) + WINDOW).tolist()
                upto = np.searchsorted(cuts, ends[1:]).tolist()
                seen: set[bytes] = set()
                shas, recipes, chunks = [], [], []
                for k in range(b - a):
                    start, stop = ends[k], ends[k + 1]
                    shas.append(hashlib.sha256(lower[start:stop]).hexdigest())
                    wanted = cuts[own[k] : upto[k]].tolist() if stop - start > LEAST else []
                    recipe, new, last = [], [], start
                    for end in recipe_bounds(start, stop, wanted):
                        body = lower[last:end]
                        name = hashlib.blake2b(body, digest_size=16, key=key).digest()
                        recipe.append(name)
                        if name not in seen:
                            seen.add(name)
                            new.append({"name": name, "body": body})
                        last = end
                    recipes.append(recipe)
                    chunks.append(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("raw").slice(a, b - a),
                        pa.array(shas, pa.string()),
                        pa.array(recipes, pa.list_(pa.binary())),
                        pa.array(chunks, pa.list_(pa.struct([("name", pa.binary()), ("body", pa.binary())]))),
                    ],
                    names=["doc_id", "raw", "text_sha256", "recipe", "chunks"],
                )

    return source.mapInArrow(lean(run), f"doc_id {id_type}, raw long, text_sha256 string, recipe array<binary>, chunks array<struct<name: binary, body: binary>>")


def recipes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", attempts: int = 3) -> DataFrame:
    """One row per document: doc_id, raw (hash of the raw text), text_sha256, verified recipe."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("raw"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    for attempt in range(attempts):
        chunked = written(_chunked(source, id_type, str(attempt).encode()), "recipes")
        bodies = chunked.select(F.explode("chunks").alias("c")).select("c.name", "c.body").distinct()
        clashes = bodies.groupBy("name").count().where("count > 1")
        if clashes.isEmpty():
            return chunked.drop("chunks")
    raise RuntimeError("chunk names clash under every key")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, raw."""
    rows = recipes_of(docs, id_col, text_col).groupBy("doc_id", "raw", "recipe", "text_sha256").agg(F.count("*").alias("n"))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col("raw"))).alias("best"))
    # written, so that both sides of the join are plain exchanges, which Spark can split
    both = rows.join(written(groups, "groups"), "recipe")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("raw") == F.col("best.raw"))
    return both.select("doc_id", "keep_id", "group_size", first.alias("first"), "text_sha256", "raw", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("turn")).select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("turn") == 1)).alias("kept"), "text_sha256", "raw")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text another kept row has."""
    marks = find_copies(docs, id_col, text_col)
    keys = marks.groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept")).where("n_kept < n")
    return drop_marked(docs, keys, id_col, text_col)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents")).drop("raw")


OP8_SQL = """
with n as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id,
       max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from n
"""
