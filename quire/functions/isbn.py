"""ISBN checks and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.text import let


def _digit(x: Column, k: int) -> Column:
    return F.substring(x, k + 1, 1).try_cast("int")


def valid13(x: Column) -> Column:
    total = sum((_digit(x, k) * (3 if k % 2 else 1) for k in range(1, 12)), _digit(x, 0))
    return F.when(x.rlike(r"^97[89][0-9]{10}$"), (10 - total % 10) % 10 == _digit(x, 12)).otherwise(False)


def valid10(x: Column) -> Column:
    total = sum((_digit(x, k) * (10 - k) for k in range(1, 9)), _digit(x, 0) * 10)
    last = F.when(F.upper(F.substring(x, 10, 1)) == "X", 10).otherwise(_digit(x, 9))
    return F.when(x.rlike(r"^[0-9]{9}[0-9Xx]$"), (total + last) % 11 == 0).otherwise(False)


def normalize(x: Column) -> Column:
    """The bare valid ISBN, or the empty string."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9Xx]", "")
    return let(bare, lambda v: F.when(valid13(v), v).when(valid10(v), F.upper(v)).otherwise(""))


def extract(text: Column, most: int = 3) -> Column:
    """Up to ``most`` distinct valid ISBNs, by pattern and then by place."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){p}"), F.lit(1)) for p in C.ISBN_PATTERNS))
    return F.slice(F.array_distinct(F.filter(F.transform(found, normalize), lambda x: x != "")), 1, most)
