"""The corpus queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gridloom.llm import decontam, divergence, langid, lines, media, minhash, mixing, pii, quality, secrets, substring, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, sf_dir) -> DataFrame."""
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_personal_data": pii.op3_personal_data,
        "op4_language": langid.op4_language,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_near_duplicates": minhash.op6_near_duplicates,
        "op7_secrets": secrets.op7_secrets,
        "op8_media_columns": media.op8_media_columns,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_substring_dedup": substring.op10_substring_dedup,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_quality": quality.op13_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, where SQL can express the operator."""
    return {"op2_mixing": mixing.SQL, "op11_prefix_trie": trie.SQL, "op12_source_divergence": divergence.SQL}
