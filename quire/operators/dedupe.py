"""First-writer-wins by content hash, duplicate groups, latest status, unique names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(rows: DataFrame, key: str, order: list[str], known: DataFrame | None = None, canonical: str = "canonical") -> DataFrame:
    """Adds ``status`` (unique or duplicate) and ``canonical``, the first row's value.

    ``known`` holds keys claimed before (key, canonical). The first row of a key is a grouped
    minimum over ``order``, combined before the shuffle, and an equi-join that Spark may split: a
    key that many rows share is never gathered in one task. Rows that tie in all of ``order`` are
    told apart by nothing, so give an order that names a row. Null keys are never duplicates.
    """
    names = [f"__o{k}" for k in range(len(order))]
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*(F.col(c).alias(n) for c, n in zip(order, names, strict=True)))).alias("__first"))
    out = rows.join(first, F.col(key) == F.col("__k"), "left")
    same = F.col("__k").isNull()
    for k, (c, n) in enumerate(zip(order, names, strict=True)):
        term = F.col(c).eqNullSafe(F.col(f"__first.{n}"))
        match = term if k == 0 else match & term  # noqa: F821
    out = out.withColumn("__mine", same | match).withColumn(canonical, F.when(same, F.col(order[-1])).otherwise(F.col(f"__first.{names[-1]}")))
    if known is not None:
        past = known.select(F.col(key).alias("__p"), F.col(canonical).alias("__past"))
        out = out.join(past, F.col(key) == F.col("__p"), "left").withColumn("__mine", F.col("__mine") & F.col("__p").isNull()).withColumn(canonical, F.coalesce("__past", canonical)).drop("__p", "__past")
    return out.withColumn("status", F.when(F.col("__mine"), "unique").otherwise("duplicate")).drop("__k", "__first", "__mine")


def duplicate_groups(rows: DataFrame, key: str, first: str) -> DataFrame:
    """Keys that several rows share: the first row and how many there are."""
    return rows.groupBy(key).agg(F.min(first).alias("first_id"), F.count("*").alias("n_docs")).where("n_docs > 1")


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last event."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(key).agg(last.alias("__v")).select(key, "__v.*")


def _numbered(rows: DataFrame, group: list[str], turn: str, taken: DataFrame) -> DataFrame:
    """Adds ``__free``: the ``turn``-th whole number from 1 on that is not ``taken`` in the group.

    ``taken`` has the group's columns and ``__t``. Before the j-th taken number b there are b - j
    free ones, so a running count of taken numbers, in the order of that difference, is what a
    row has to skip.
    """
    blocked = taken.distinct().withColumn("__at", F.col("__t") - F.row_number().over(Window.partitionBy(*group).orderBy("__t"))).withColumn("__b", F.lit(1)).drop("__t")
    both = rows.withColumn("__at", F.col(turn).cast("long")).withColumn("__b", F.lit(0)).unionByName(blocked, allowMissingColumns=True)
    skip = F.sum("__b").over(Window.partitionBy(*group).orderBy("__at", "__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("__free", F.col("__at") + skip).where("__b = 0").drop("__at", "__b")


def _numbers_in_names(rows: DataFrame, pattern: str, groups: int) -> DataFrame:
    """Different names whose stem fits ``pattern``: what it numbers, then its other groups."""
    g = lambda k: F.regexp_extract("__stem", pattern, k)
    names = rows.select("__stem", "__end").distinct().where(F.col("__stem").rlike(pattern))
    return names.select(F.concat(g(1), F.col("__end")).alias("__dest"), *(g(k).alias(f"__g{k}") for k in range(2, groups + 1)))


#: What a name may be read as: the number, or the hash and number, that was added to another name.
_NUMBERED = "^(.*)_([1-9][0-9]{0,17})$"
_HASHED = "^(.*)_([^_]{1,8})$"
_HASHED_AGAIN = "^(.*)_([^_]{1,8})_([1-9][0-9]{0,16})$"


def _in_use(named: DataFrame, taken: DataFrame | None, stem, suffix) -> DataFrame:
    """(__stem, __end) of the rows' own names and of those ``taken`` by earlier runs."""
    own = named.select("__stem", "__end")
    if taken is None:
        return own
    name = taken.columns[0]
    return own.unionByName(taken.where(F.col(name).isNotNull()).select(stem(F.col(name)).alias("__stem"), suffix(F.col(name)).alias("__end")))


def _held(named: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Adds ``__held``: 1 where an earlier run has the row's name, else 0."""
    if taken is None:
        return named.withColumn("__held", F.lit(0))
    past = taken.select(F.col(taken.columns[0]).alias("__past")).where("__past is not null").distinct()
    return named.join(past, F.col("__dest") == F.col("__past"), "left").withColumn("__held", F.col("__past").isNotNull().cast("int")).drop("__past")


def _fixed(x: Column | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return x if callable(x) and not isinstance(x, Column) else lambda _: x


def _of_rows(taken: DataFrame, named: DataFrame, group: list[str]) -> DataFrame:
    """Numbers in names, of the groups that a row is in."""
    return taken.join(named.select(*group).distinct(), group, "left_semi")


def unique_names(rows: DataFrame, dest: str, order: list[str], stem: Column | Callable, suffix: Column | Callable, taken: DataFrame | None = None) -> DataFrame:
    """Adds ``unique_dest``: the name for its first row, then stem_1, stem_2, ... that are free.

    A number is free if no row asks for that name itself, so no two rows get one name. ``taken`` (its
    first column) has the names of earlier runs: none is given again, and the first row too is
    numbered where its name is among them. With it, ``stem`` and ``suffix`` are functions of a name.
    """
    n = F.row_number().over(Window.partitionBy("__dest").orderBy(*order)) - 1
    stem, suffix = _fixed(stem), _fixed(suffix)
    named = rows.withColumn("__stem", stem(F.col(dest))).withColumn("__end", suffix(F.col(dest))).withColumn("__dest", F.col(dest))
    named = _held(named, taken).withColumn("__n", n + F.col("__held")).drop("__held")
    numbers = _numbers_in_names(_in_use(named, taken, stem, suffix), _NUMBERED, 2).select("__dest", F.col("__g2").try_cast("long").alias("__t"))
    out = _numbered(named, ["__dest"], "__n", _of_rows(numbers, named, ["__dest"]))
    unique = F.when(F.col("__n") == 0, F.col(dest)).otherwise(F.concat("__stem", F.lit("_"), F.col("__free").cast("string"), "__end"))
    return out.withColumn("unique_dest", unique).drop("__stem", "__end", "__dest", "__n", "__free")


def unique_names_by_hash(rows: DataFrame, dest: str, digest: str, order: list[str], stem: Column | Callable, suffix: Column | Callable, taken: DataFrame | None = None) -> DataFrame:
    """The same with stem_<hash8>, then stem_<hash8>_1, ... for further rows of one hash."""
    n = F.row_number().over(Window.partitionBy("__dest").orderBy(*order))
    eight = F.left(F.coalesce(F.nullif(F.col(digest), F.lit("")), F.lit("x")), F.lit(8))
    stem, suffix = _fixed(stem), _fixed(suffix)
    named = rows.withColumn("__stem", stem(F.col(dest))).withColumn("__end", suffix(F.col(dest))).withColumn("__dest", F.col(dest))
    named = _held(named, taken).withColumn("__n", n + F.col("__held")).drop("__held").withColumn("__h", eight)
    own = Window.partitionBy("__dest", "__h")
    named = named.withColumn("__m", F.row_number().over(own.orderBy("__n")) - F.max((F.col("__n") == 1).cast("int")).over(own))
    in_use = _in_use(named, taken, stem, suffix)
    # stem_<hash8> is number 1 of its hash, stem_<hash8>_i is number i + 1
    plain = _numbers_in_names(in_use, _HASHED, 2).select("__dest", F.col("__g2").alias("__h"), F.lit(1).cast("long").alias("__t"))
    further = _numbers_in_names(in_use, _HASHED_AGAIN, 3).select("__dest", F.col("__g2").alias("__h"), (F.col("__g3").try_cast("long") + 1).alias("__t"))
    out = _numbered(named, ["__dest", "__h"], "__m", _of_rows(plain.union(further), named, ["__dest", "__h"]))
    again = F.when(F.col("__free") > 1, F.concat(F.lit("_"), (F.col("__free") - 1).cast("string"))).otherwise("")
    unique = F.when(F.col("__n") == 1, F.col(dest)).otherwise(F.concat("__stem", F.lit("_"), "__h", again, "__end"))
    return out.withColumn("unique_dest", unique).drop("__stem", "__end", "__dest", "__n", "__h", "__m", "__free")


def last_events(events: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return events.orderBy(*(F.desc(c) for c in order)).limit(n)
