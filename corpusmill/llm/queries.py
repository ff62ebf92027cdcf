"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.op1_line_dedup import op1_line_dedup
from corpusmill.llm.op10_order_minhash import op10_order_minhash
from corpusmill.llm.op2_packing import op2_best_two_fit_packing
from corpusmill.llm.op3_arrow_stream import op3_arrow_stream_output
from corpusmill.llm.op4_rules import op4_rule_quality
from corpusmill.llm.op5_suffix import op5_suffix_dedup
from corpusmill.llm.op6_media import op6_media_png
from corpusmill.llm.op7_topk import OP7_SQL, op7_norm_bucket_topk
from corpusmill.llm.op8_mixing import OP8_SQL, op8_mix_sources
from corpusmill.llm.op9_compaction import op9_tiered_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup,
        op2_best_two_fit_packing,
        op3_arrow_stream_output,
        op4_rule_quality,
        op5_suffix_dedup,
        op6_media_png,
        op7_norm_bucket_topk,
        op8_mix_sources,
        op9_tiered_shards,
        op10_order_minhash,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_norm_bucket_topk": OP7_SQL, "op8_mix_sources": OP8_SQL}
