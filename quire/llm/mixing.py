"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only.

1. A source's target is the least of ``most`` times its size and its weight times a common level,
   the level at which all targets add up to the whole.
2. Rows fall into blocks by a hash. A source gives whole passes while its target allows, then
   blocks in the order of a seeded permutation until the rest is filled; the last block gives its
   rows in hashed order up to the rest. What a source gives is thus told by a few numbers, and
   each row decides for itself: no text is moved to make the mix.
3. Every pass over a block is one draw. A tree over the output shards halves the draws of a node
   by seeded rank again and again, which deals each shard a multivariate-hypergeometric share of
   every source. Draws are disjoint; rows are shuffled within their shard only.

Tables by source or by (source, block) are all that is gathered; their sizes do not depend on the
number of rows.

Defined results: a null text has size 0 and is taken with 0 words; a null source is a source of
its own, ordered last; rows that repeat id and text share a decision; sources of size 0 have
target 0; an empty table gives no rows; extra columns are ignored by ``shares`` and kept by
``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
BLOCKS = 256
LONG = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size, blk (its place in the permutation of blocks), k (place in the block)."""
    text = F.col(text_col).cast("string")
    k = F.xxhash64(F.lit(seed), F.col(id_col), text)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _order(k, seed).alias("blk"), k.alias("k"))


def _order(k: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.pmod(k, F.lit(BLOCKS)))


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with weight and target. One row per source in, one out."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("reach", most * F.col("source_size") / F.col("weight"))
    by_reach = Window.orderBy("reach", F.asc_nulls_last("source"))
    upto, every = by_reach.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    # the level if all sources of smaller reach stop at their limit; the highest one is the true one
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max("level").over(every))
    return ranked.select("source", "source_size", "weight", F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def shares(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """By source: size, target, whole passes, and where the last pass ends; and block sizes.

    Rows above a thousandth of their source (so fewer than a thousand) are picked for the last
    pass singly, by seeded order if they fit; blocks then fill what is left with the others.
    """
    rows = written(_rows(docs, id_col, text_col, source_col, seed).drop("doc_id"), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, most, weights).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = written(goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "mix-goals")
    both = _beside(rows, goal.select("source", "source_size", "rest"))
    big = F.col("size") * LONG > F.col("source_size")
    # equal rows share a decision, so they are one item
    items = both.where(big).groupBy("source", "source_size", "rest", "k").agg(F.sum("size").alias("size"))
    picks = items.groupBy("source", "source_size", "rest").agg(F.sum("size").alias("big_words"), F.sort_array(F.collect_list(F.struct("k", "size"))).alias("rows"))
    room = F.when(F.col("big_words") * LONG >= F.col("source_size") * (LONG - 1), F.col("rest")).otherwise(F.col("rest") * F.col("big_words") / F.col("source_size"))
    # from the share of long rows in the source, take each in turn if it fits; longest first only
    # where chance leaves a gap
    by_chance = _fitted(F.col("rows"), room)
    by_size = _fitted(F.sort_array(F.transform("rows", lambda x: F.struct((-x["size"]).alias("s"), x["k"].alias("k"), x["size"].alias("size")))), room)
    gap = (by_chance["room"] * 200 > F.col("source_size")) & (by_size["room"] < by_chance["room"])
    picks = picks.select("source", F.when(gap, by_size).otherwise(by_chance).alias("fit"), room.alias("room")).select("source", "fit.picks", (F.col("room") - F.col("fit.room")).alias("picked"))
    goal = _beside(goal, picks).withColumn("fill", F.greatest(F.lit(0.0), F.col("rest") - F.coalesce("picked", F.lit(0.0))))
    goal = written(goal.withColumn("picks", F.coalesce("picks", F.array().cast("array<bigint>"))).drop("picked"), "mix-picks")
    blocks = written(both.groupBy("source", "blk").agg(F.sum(F.when(~big, F.col("size")).otherwise(0)).alias("words")), "mix-blocks")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("blk")) - F.col("words")
    # the block in which the last pass ends, and what is left for it
    ends = _beside(blocks.withColumn("before", before), goal.select("source", "fill"))
    ends = ends.where("words > 0 and before <= fill").groupBy("source", "fill").agg(F.max_by("blk", "before").alias("end_blk"), F.max("before").alias("before")).select("source", "end_blk", (F.col("fill") - F.col("before")).alias("room"))
    inside = _beside(both.where(~big), ends).where("blk = end_blk").groupBy("source", "k", "room").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("k"))
    # a row is in if that brings the sum nearer to the fill
    cut = inside.withColumn("run", running).where(F.col("run") - F.col("size") / 2 <= F.col("room")).groupBy("source").agg(F.max("k").alias("end_k"))
    return written(_beside(_beside(goal, ends.drop("room")), cut), "mix-shares"), blocks


def _fitted(items: Column, room: Column) -> Column:
    """struct(room left, picks): each (k, size) in turn that still fits."""
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("picks"))
    return F.aggregate(items, start, lambda a, x: F.when(x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.array_append(a["picks"], x["k"]).alias("picks"))).otherwise(a))


def _beside(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Left join on the source, null being equal to null."""
    named = by_source.withColumnRenamed("source", "__s")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _copies(rows: DataFrame, share: DataFrame) -> DataFrame:
    """``rows`` (with source, size, blk, k) and the share of their source, with ``copies``."""
    fills = (F.col("blk") < F.col("end_blk")) | ((F.col("blk") == F.col("end_blk")) & (F.col("k") <= F.col("end_k")))
    extra = F.when(F.col("size") * LONG > F.col("source_size"), F.array_contains("picks", F.col("k"))).otherwise(F.coalesce(fills, F.lit(False)))
    return _beside(rows, share).withColumn("copies", F.col("passes") + extra.cast("int"))


def splitting_tree(share: DataFrame, blocks: DataFrame, levels: int, seed: int = 7) -> DataFrame:
    """(source, blk, shards): the output shard of each pass over a block, by 2**levels shards.

    At each node the draws are ranked by a seeded hash and halved, so the number that goes left
    from each source follows the multivariate hypergeometric law while quotas stay exact.
    """
    used = F.coalesce(F.col("blk") <= F.col("end_blk"), F.lit(False)) | F.exists("picks", lambda p: _order(p, seed) == F.col("blk"))
    draws = _beside(blocks, share).withColumn("n", F.col("passes") + used.cast("int")).where("n > 0").select("source", "blk", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass")).withColumn("node", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("node")
        rank = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "blk", "pass"), "source", "blk", "pass"))
        draws = draws.withColumn("node", F.col("node") * 2 + (rank * 2 > F.count("*").over(node)).cast("int"))
    # at most ``most`` + 1 passes for each block
    return draws.groupBy("source", "blk").agg(F.array_sort(F.collect_list(F.struct("pass", "node"))).alias("p")).select("source", "blk", F.col("p.node").alias("shards"))


def mix(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS, levels: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", placed: bool = False) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, all columns.

    ``placed`` adds ``shard``; a task holds cuts of a shard's blocks, in the order of the permuted
    blocks, and shuffles the rows of each.
    """
    share, blocks = shares(docs, most, weights, seed, id_col, text_col, source_col)
    k = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, word_count(F.col(text_col).cast("string")).alias("size"), F.col(source_col).cast("string").alias("source"), _order(k, seed).alias("blk"), k.alias("k"))
    taken = _copies(rows, share).where("copies > 0")
    if not placed:
        return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
    tree = splitting_tree(share, blocks, levels, seed).withColumnsRenamed({"source": "__s", "blk": "__b"})
    taken = taken.join(tree, F.col("source").eqNullSafe(F.col("__s")) & (F.col("blk") == F.col("__b")))
    spread = taken.select("row", "blk", "k", F.posexplode(F.slice("shards", F.lit(1), F.col("copies"))).alias("copy", "shard"))
    # a block's draws may be many rows: cut by row, so that no shard or block is one task's work
    cut = F.pmod(F.xxhash64("k", "copy"), F.lit(64))
    return spread.repartition("shard", "blk", cut).sortWithinPartitions("shard", "blk", F.xxhash64("k", "copy", "shard")).select("row.*", "shard")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    share, blocks = shares(docs)
    tree = splitting_tree(share, blocks, levels=3).withColumnsRenamed({"source": "__s", "blk": "__b"})
    rows = _copies(_rows(docs, "doc_id", "text", "source", 7), share)
    rows = rows.join(tree, F.col("source").eqNullSafe(F.col("__s")) & (F.col("blk") == F.col("__b")), "left")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.array_join(F.slice("shards", F.lit(1), F.col("copies")), ",").alias("shards"))
