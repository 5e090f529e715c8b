"""Queries of the corpus operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, filter_audit
from quire.llm.byte_bpe import op3_byte_bpe
from quire.llm.exact_dedup import op8_exact_dedup
from quire.llm.embedding_dedup import op9_embedding_dedup
from quire.llm.filter_audit import op12_filter_audit
from quire.llm.fingerprints import op11_fingerprints
from quire.llm.mixing import op6_mixing
from quire.llm.ngram_join import op5_ngram_join
from quire.llm.pii import op4_pii
from quire.llm.quality import op7_quality_gam
from quire.llm.repeats import op10_rindex_repeats
from quire.llm.sharding import op1_mcf_sharding
from quire.llm.toxicity import op2_toxicity
from quire.llm.whitening import op13_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mcf_sharding": op1_mcf_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_pii": op4_pii,
        "op5_ngram_join": op5_ngram_join,
        "op6_mixing": op6_mixing,
        "op7_quality_gam": op7_quality_gam,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_rindex_repeats": op10_rindex_repeats,
        "op11_fingerprints": op11_fingerprints,
        "op12_filter_audit": op12_filter_audit,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.OP8_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
