"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, exact_dedup, language, licences, mixing, neighbours, repeats, runs, scoring, simhash, spelling, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        licences.op1_license_scan,
        scoring.op2_lm_scoring,
        bpe.op3_bpe_encoding,
        mixing.op4_source_mix,
        exact_dedup.op5_exact_dedup,
        language.op6_language_id,
        simhash.op7_simhash_near_dedup,
        toxicity.op8_toxicity,
        repeats.op9_repeated_bytes,
        neighbours.op10_nearest_neighbours,
        spelling.op11_spelling_variants,
        tokens.op12_token_counts,
        runs.op13_periodic_runs,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.OP5_SQL}
