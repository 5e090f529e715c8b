"""Minimum-cost-flow resharding: even out shards while moving the fewest bytes.

1. Rows fall into blocks by old shard and hash of their text. Block sizes are summed in Spark; a
   block above a sixteenth of a new shard (a hot text) is cut by document id, as no shard could
   take it whole: copies of such a text may part, all other equal texts of an old shard stay
   together. The number of blocks is bounded by parameters, whatever the input.
2. Old shard sizes and new capacities form a small flow network (old shard -> new shard, free
   for staying, one per byte for moving) that is solved on the driver.
3. Whole blocks are chosen to carry each flow, largest first, each to the target with most room.
4. Slots within a shard come from the block's offset plus a running number inside the block.

Where the old shards are is told by a column of the rows (``old_col``), whose null or unknown
values are rows of no shard, free to go anywhere; without one the layout is taken to be by hash.

Defined results: a null text has size 1 and the checksum of no bytes; a null id is a value like
any other; rows that repeat an id keep separate slots, and rows that tie in id and text take their
slots in any order; an empty table gives no rows; extra columns are ignored by ``assign`` and kept
by ``reshard_files``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table


def solve_transfers(old_sizes: list[int], capacities: list[int], loose: int | None = None) -> list[list[int]]:
    """Flow[i][j] of bytes from old shard i to new shard j of least moved bytes.

    Successive shortest augmenting paths on the transport network; capacities must cover the
    sizes. Shard i staying shard i costs nothing, any other byte costs one; what ``loose`` holds
    is in no shard yet and costs the same wherever it goes.
    """
    n, m = len(old_sizes), len(capacities)
    if sum(capacities) < sum(old_sizes):
        raise ValueError("capacities do not cover the shards")
    flow = [[0] * m for _ in range(n)]
    left, room = list(old_sizes), list(capacities)
    cost = lambda i, j: 0 if i == j and i != loose else 1
    while any(left):
        # nodes 0..n-1 old shards, n..n+m-1 new shards; costs can be negative on reverse arcs
        dist, came = [float("inf")] * (n + m), [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                queue.append(i)
        while queue:
            u = queue.pop(0)
            if u < n:
                arcs = [(n + j, cost(u, j)) for j in range(m)]
            else:
                arcs = [(i, -cost(i, u - n)) for i in range(n) if flow[i][u - n]]
            for v, c in arcs:
                if dist[u] + c < dist[v]:
                    dist[v], came[v] = dist[u] + c, u
                    if v not in queue:
                        queue.append(v)
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, v = [n + end], n + end
        while came[v] >= 0:
            v = came[v]
            path.append(v)
        path.reverse()
        push = min(left[path[0]], room[end], *(flow[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n)) if len(path) > 2 else min(left[path[0]], room[end])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[path[0]] -= push
        room[end] -= push
    return flow


def place_blocks(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> dict[int, int]:
    """New shard of each (block, old shard, bytes): largest blocks first, to the most room left."""
    rooms = {i: [(-f, j != i, j) for j, f in enumerate(row) if f] for i, row in enumerate(flow)}
    for heap in rooms.values():
        heapq.heapify(heap)
    placed = {}
    for block, old, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        neg, away, j = heapq.heappop(rooms[old])
        placed[block] = j
        heapq.heappush(rooms[old], (neg + size, away, j))
    return placed


def _old_shard(n_old: int, old_col: str | None, text: Column) -> Column:
    if old_col is None:
        return F.pmod(F.xxhash64(F.lit(1), text), F.lit(n_old)).cast("long")
    known = F.col(old_col).cast("long")
    return F.when(known.between(0, n_old - 1), known).otherwise(F.lit(n_old).cast("long"))


def _cell(n_old: int, old_col: str | None, text_col: str, cells: int) -> Column:
    text = F.col(text_col).cast("string")
    return _old_shard(n_old, old_col, text) * cells + F.pmod(F.xxhash64(text), F.lit(cells))


def plan(docs: DataFrame, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, weights: list[float] | None = None, cells: int = 512, most_parts: int = 256) -> tuple[DataFrame, DataFrame, list[list[int]]]:
    """Rows with their block; blocks with their new shard and offset; the solved flow.

    ``weights`` are the new shards' shares of all bytes (equal ones if not given). At most
    ``(n_old + 1) * cells`` blocks and ``most_parts`` parts for each block that is above a
    sixteenth of a new shard; there are fewer than ``16 * n_new`` of those.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        _cell(n_old, old_col, text_col, cells).alias("cell"),
    )
    coarse = {r["cell"]: r["bytes"] for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes")).collect()}
    step = max(1, sum(coarse.values()) // (n_new * 16))
    hot = {c: min(most_parts, -(-16 * size // step)) for c, size in coarse.items() if size > step}
    parts = spark.createDataFrame([(c, p) for c, p in hot.items()], "cell long, parts int")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = rows.join(F.broadcast(parts), "cell", "left").withColumn("block", F.col("cell") * most_parts + part).drop("parts")
    stats = sorted((r["block"], r["bytes"], r["n"]) for r in rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    old_of = lambda block: block // most_parts // cells
    old_sizes = [0] * (n_old + 1)
    for block, size, _ in stats:
        old_sizes[old_of(block)] += size
    shares = weights or [1.0] * n_new
    ends = [round(sum(old_sizes) * (sum(shares[:k]) / sum(shares))) for k in range(n_new + 1)]
    flow = solve_transfers(old_sizes, [b - a for a, b in zip(ends, ends[1:], strict=False)], loose=n_old)
    placed = place_blocks([(b, old_of(b), size) for b, size, _ in stats], flow)
    offset, out = [0] * n_new, []
    for block, _, n in stats:
        cell = block // most_parts
        out.append((block, placed[block], offset[placed[block]], cell, hot.get(cell, 1)))
        offset[placed[block]] += n
    return rows, spark.createDataFrame(out, "block long, shard int, offset long, cell long, parts int"), flow


def assign(docs: DataFrame, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, **how) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows, blocks, _ = plan(docs, n_old, n_new, id_col, text_col, old_col, **how)
    inside = Window.partitionBy("block").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(blocks.drop("cell", "parts")), "block").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def rewritten(docs: DataFrame, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, **how) -> tuple[DataFrame, dict[int, bool]]:
    """The rows of the shards that change, with column ``shard``, and for each shard whether it does.

    A shard changes if a block enters or leaves it (or it is new). A row's block follows from the row,
    so rows of other shards are passed over where they are read, and no text moves to find its shard.
    """
    _, blocks, _ = plan(docs, n_old, n_new, id_col, text_col, old_col, **how)
    most_parts, cells = how.get("most_parts", 256), how.get("cells", 512)
    affected = {k: k >= n_old for k in range(n_new)}
    for block, shard, *_ in blocks.collect():  # bounded by the parameters of plan()
        if (old := block // most_parts // cells) != shard:
            affected |= {k: True for k in (old, shard) if k < n_new}
    wanted = blocks.where(F.col("shard").isin([k for k, yes in affected.items() if yes]))
    cut = wanted.select(F.col("cell").alias("__cell"), F.col("parts").alias("__parts")).distinct()
    placed = wanted.select(F.col("block").alias("__block"), F.col("shard").alias("__shard"))
    source = docs.withColumn("__own", _cell(n_old, old_col, text_col, cells))
    source = source.join(F.broadcast(cut), F.col("__own") == F.col("__cell"))
    part = F.when(F.col("__parts") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), F.col("__parts")).cast("int"))
    moved = source.withColumn("__at", F.col("__own") * most_parts + part).join(F.broadcast(placed), F.col("__at") == F.col("__block"))
    kept = [c for c in docs.columns if c != old_col]
    return moved.select(*kept, F.col("__shard").alias("shard")), affected


def reshard_files(docs: DataFrame, out: str, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, **how) -> dict[int, bool]:
    """Write the shards that change as ``out/shard=<k>``; tell for each whether it was rewritten.

    The files of others stay as they are. ``old_col`` is not written, the folder says it.
    """
    moved, affected = rewritten(docs, n_old, n_new, id_col, text_col, old_col, **how)
    moved.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(64))).write.partitionBy("shard").parquet(out)
    return affected


def op1_mcf_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), n_old=6, n_new=8)
