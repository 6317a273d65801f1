"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import blockmatrix, htmltext, language, mixing, neardup, packing, quality, substring, suffixarray, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_anchor_dedup": substring.op1_anchor_dedup,
    "op2_text_density": htmltext.op2_text_density,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_ngram_ratio": quality.op4_ngram_ratio,
    "op5_interval_dedup": suffixarray.op5_interval_dedup,
    "op6_bbit_minhash": neardup.op6_bbit_minhash,
    "op7_hypergeometric_mix": mixing.op7_hypergeometric_mix,
    "op8_string_kernel_language": language.op8_string_kernel_language,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_block_nearest": blockmatrix.op10_block_nearest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_anchor_dedup": substring.OP1_SQL,
    "op7_hypergeometric_mix": mixing.OP7_SQL,
    "op9_warc_revisits": warc.OP9_SQL,
    "op10_block_nearest": blockmatrix.OP10_SQL,
}
