"""The registry of this subpackage's queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import centroids, credentials, hamming, jaccard, licences, mixing, negatives, packing, pivots, quality, suffix_dedup, suffix_tree, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_licences": licences.op3_licences,
    "op4_pivots": pivots.op4_pivots,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_hamming": hamming.op7_hamming,
    "op8_suffix_tree": suffix_tree.op8_suffix_tree,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_negatives": negatives.op11_negatives,
    "op12_centroids": centroids.op12_centroids,
    "op13_credentials": credentials.op13_credentials,
}
ORACLES: dict[str, str] = {"op3_licences": licences.ORACLE, "op11_negatives": negatives.SQL, "op12_centroids": centroids.SQL, "op13_credentials": credentials.SQL}
