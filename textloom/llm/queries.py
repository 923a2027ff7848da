"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import media, mixing, neardup, packing, periodic, pii, quality, ranked, sharding, suffix, suffix_tree_lm, token_counts, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_odd_sketch": neardup.op1,
    "op2_histogram_sort": sharding.op2,
    "op3_rotation_codes": vectors.op3,
    "op4_pii_spans": pii.op4,
    "op5_pareto_mix": mixing.op5,
    "op6_quality_ftrl": quality.op6,
    "op7_suffix_tree_lm": suffix_tree_lm.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_ogg_media": media.op9,
    "op10_suffix_repeats": suffix.op10,
    "op11_impact_ordered": ranked.op11,
    "op12_whole_token_counts": token_counts.op12,
    "op13_periodic_runs": periodic.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_odd_sketch": neardup.ORACLE,
    "op3_rotation_codes": vectors.ORACLE,
    "op5_pareto_mix": mixing.ORACLE,
    "op11_impact_ordered": ranked.ORACLE,
}
