"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from channelgraph.llm import ann, exact, licences, lines, mixing, neardup, packing, periodic, quality, sharding, substrings, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_bwt_substrings": substrings.op2_bwt_substrings,
        "op3_content_sort": exact.op3_content_sort,
        "op4_stratified_shards": sharding.op4_stratified_shards,
        "op5_rotated_codes": ann.op5_rotated_codes,
        "op6_boosted_trees": quality.op6_boosted_trees,
        "op7_poisson_mixture": mixing.op7_poisson_mixture,
        "op8_bottom_k": neardup.op8_bottom_k,
        "op9_salvage_warc": warc.op9_salvage_warc,
        "op10_rare_token_index": licences.op10_rare_token_index,
        "op11_feast_whitening": whitening.op11_feast_whitening,
        "op12_shared_lines": lines.op12_shared_lines,
        "op13_dyadic_runs": periodic.op13_dyadic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {
        "op3_content_sort": exact.ORACLE_OP3,
        "op5_rotated_codes": ann.ORACLE_OP5,
        "op7_poisson_mixture": mixing.ORACLE_OP7,
        "op9_salvage_warc": warc.ORACLE_OP9,
        "op12_shared_lines": lines.ORACLE_OP12,
    }
