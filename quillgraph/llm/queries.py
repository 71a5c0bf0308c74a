"""The queries of this subpackage, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.decontaminate import op6_decontaminate
from quillgraph.llm.mixing import op10_mixing
from quillgraph.llm.ppm import op7_ppm_scores
from quillgraph.llm.quality_knn import op5_quality_knn
from quillgraph.llm.quality_rules import op3_quality_rules
from quillgraph.llm.simhash import op4_simhash
from quillgraph.llm.suffix_dedup import op1_suffix_dedup
from quillgraph.llm.tokens import op9_token_counts
from quillgraph.llm.toxicity import op8_toxicity
from quillgraph.llm.url_filter import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_url_filter, op3_quality_rules, op4_simhash, op5_quality_knn, op6_decontaminate, op7_ppm_scores, op8_toxicity, op9_token_counts, op10_mixing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """No operator here is expressible in SQL whole; tests/llm has brute-force versions."""
    return {}
