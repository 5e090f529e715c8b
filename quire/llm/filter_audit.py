"""Filter interaction audit: what each of five filters removes in every order they may run in.

DataFrame and SQL functions only.

1. Each document gets a mask of the filters it fails. Whether a smaller id has its text comes from a
   grouped minimum over text digests and an equi-join of narrow rows; texts are read once and
   stay where they are.
2. Walsh-Hadamard sums: for each part, and for all, good and toxic documents, the 32 signed parity
   sums over the masks, in one aggregation that is combined before the shuffle.
3. The transform is its own inverse up to the factor 32, so the sums give back the exact count of
   documents for each mask: 32 cells for each part.
4. Sums of cells tell what passes any set of filters, and so each step of every order. A filter's Shapley total needs no orders: a document
   that fails s filters is removed by each of them in 120 / s of the 120 orders.

Defined results: a null text is empty, a null source is the part ''; an empty text has no words, so
it fails A alone of A to D; a null id is smaller than none and its row never fails E, but it makes no
other row fail either; rows that repeat an id count each, and equal rows of one id do not make each
other fail E; a document is good or toxic if any label row of its id says 1, null labels and labels
of null ids say nothing; an empty table gives no rows; other columns are ignored. Two texts are
identical when their SHA-256 digests and lengths are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table, written

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    n_words = F.col("words")["n"]
    return {
        "words": F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))), F.lit(0)),
        "A": n_words < 50,
        "B": 100 * F.col("words")["distinct"] < 65 * n_words,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One narrow row per document: part, mask (bit k: fails filter k), good, toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    fails = failures(F.col("t"))
    rows = rows.withColumn("words", fails.pop("words"))
    own = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS[:4])), F.lit(0))
    rows = rows.select("id", "part", own.alias("own"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.length("t").alias("chars"))
    first = rows.groupBy(F.col("digest").alias("__d"), F.col("chars").alias("__c")).agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    # written, so that both sides of the join are exchanged and a text that many rows hold can be split
    first = written(first, "audit-copies")
    rows = rows.join(first, (F.col("digest") == F.col("__d")) & (F.col("chars") == F.col("__c")), "left")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    rows = rows.select("id", "part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    known = known.agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")).where("good = 1 or toxic = 1")
    known = written(known, "audit-labels")
    return rows.join(known, F.col("id") == F.col("__id"), "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """One row per part: how many documents (n, good, toxic) have each of the 32 masks."""
    # a sum's sign is that of the parity of the bits that mask and index share
    sign = "(1 - 2 * (bit_count({} & {}) % 2))".format
    counted = {"n": "1L", "good": "good", "toxic": "toxic"}
    sums = rows.groupBy("part").agg(*(F.expr(f"sum({sign('mask', k)} * {one}) as {name}{k}") for name, one in counted.items() for k in range(CELLS)))

    def inverse(name: str) -> Column:
        parities = ", ".join(f"{name}{k} * {sign('mask', k)}" for k in range(CELLS))
        return F.expr(f"transform(sequence(0, {CELLS - 1}), mask -> shiftright({parities.replace(', ', ' + ')}, 5)) as {name}")

    return sums.select("part", *map(inverse, counted))


def _summed(cell: str, weight) -> Column:
    """For each set of filters: the cells' sum, each times its weight for the set."""
    one = lambda chosen: F.aggregate(F.transform(F.col(cell), lambda n, mask: n * weight(mask, chosen)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), one)


def survivors(parts: DataFrame) -> DataFrame:
    """Adds, for each set of filters, what passes all of them, and a single filter's Shapley total."""
    passes = lambda mask, chosen: (mask.bitwiseAND(chosen) == 0).cast("long")
    share = lambda mask, chosen: F.when(mask.bitwiseAND(chosen) != 0, (120 / F.greatest(F.lit(1), F.bit_count(mask))).cast("long")).otherwise(0)
    return parts.select("*", *(_summed(c, passes).alias(f"{c}_left") for c in ("n", "good", "toxic")), _summed("n", share).alias("shares"))


def steps() -> Column:
    """All orders as rows (filter_order, step, before: bits of the filters that ran, bit): 600, whatever the input."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(f"struct('{''.join(order)}' as filter_order, {step} as step, {before} as before, {bit} as bit)")
            before |= bit
    return F.expr(f"array({', '.join(out)})")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order and step: what is kept, removed and lost there."""
    parts = survivors(cells(masks(docs, labels, id_col, text_col, part_col)))
    rows = parts.select("*", F.explode(steps()).alias("at")).select(*parts.columns, "at.*")
    before, both, own = F.col("before"), F.col("before").bitwiseOR(F.col("bit")), F.col("bit")
    at = lambda cell, x: F.get(F.col(cell), x)
    gone = lambda cell: at(cell, before) - at(cell, both)
    return rows.select(
        "part", "filter_order", "step",
        at("n_left", both).alias("kept"),
        gone("n_left").alias("removed"),
        (at("n_left", F.lit(0)) - at("n_left", own) - gone("n_left")).alias("redundant"),
        at("n", own).alias("unique_fails"),
        gone("good_left").alias("good_lost"),
        gone("toxic_left").alias("toxic_lost"),
        at("shares", own).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), copies as (
  select t, min(doc_id) as least from words group by t
), judged as (
  select x.doc_id, x.part,
    (len(w) < 50) as a,
    (100 * len(list_distinct(w)) < 65 * len(w)) as b,
    (100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 5 * length(x.t)) as c,
    regexp_matches(x.t, '[#$%&*|]') as d,
    coalesce(x.doc_id > y.least, false) as e
  from words x join copies y on x.t = y.t
), known as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), failing as (
  select j.part, coalesce(k.good, 0) as good, coalesce(k.toxic, 0) as toxic,
    concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as fails
  from judged j left join known k on j.doc_id = k.doc_id
), counts as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failing group by part, fails
), letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
  select concat(p.f, q.f, r.f, s.f, u.f) as filter_order
  from letters p, letters q, letters r, letters s, letters u
  where p.f not in (q.f, r.f, s.f, u.f) and q.f not in (r.f, s.f, u.f) and r.f not in (s.f, u.f) and s.f <> u.f
), steps as (
  select filter_order, cast(k as integer) as step, substr(filter_order, k, 1) as f, left(filter_order, k - 1) as before from orders, (select unnest([1, 2, 3, 4, 5]) as k)
), effect as (
  select s.filter_order, s.step, s.f, c.part, c.fails, c.n, c.good, c.toxic, contains(c.fails, s.f) as own,
    (s.before <> '' and regexp_matches(c.fails, concat('[', case when s.before = '' then '_' else s.before end, ']'))) as gone
  from steps s, counts c
), summed as (
  select part, filter_order, step, f,
    sum(case when not own and not gone then n else 0 end) as kept,
    sum(case when own and not gone then n else 0 end) as removed,
    sum(case when own and gone then n else 0 end) as redundant,
    sum(case when fails = f then n else 0 end) as unique_fails,
    sum(case when own and not gone then good else 0 end) as good_lost,
    sum(case when own and not gone then toxic else 0 end) as toxic_lost
  from effect group by part, filter_order, step, f
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley
from summed
"""
