"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, divergence, jaccard, licenses, mixing, near, neighbours, quality, ranking, secrets, substrings, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": substrings.op1_substrings,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_token_file": tokens.op3_token_file,
    "op4_near_duplicates": near.op4_near_duplicates,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_secrets": secrets.op8_secrets,
    "op9_licenses": licenses.op9_licenses,
    "op10_mix": mixing.op10_mix,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_search": ranking.op12_search,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES: dict[str, str] = {"op8_secrets": secrets.OP8_SQL, "op10_mix": mixing.OP10_SQL, "op12_search": ranking.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
