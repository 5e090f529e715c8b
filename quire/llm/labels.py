"""Bounded, repeatable samples of labelled rows for the operators that learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of about ``most`` labelled rows at most that may be learnt from.

    Rows are chosen by a hash of the id, so reruns agree and no row order matters. Null labels and
    null ids are left out; an id labelled several ways counts as its rounded mean.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about ``most`` ids: a proven bound for the broadcast
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["__id"]).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), "y")
