"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from secstream.llm import conversations, decontaminate, lines, mixing, quality_llr, secrets, sharding, simhash, substrings, token_counts, toxicity, warc, zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_chunks": warc.op1_warc_chunks,
    "op2_quality_llr": quality_llr.op2_quality_llr,
    "op3_secret_trigrams": secrets.op3_secret_trigrams,
    "op4_substring_anchors": substrings.op4_substring_anchors,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_simhash_pigeonhole": simhash.op6_simhash_pigeonhole,
    "op7_benchmark_edit_matches": decontaminate.op7_benchmark_edit_matches,
    "op8_toxicity_crf": toxicity.op8_toxicity_crf,
    "op9_mixing_rates": mixing.op9_mixing_rates,
    "op10_shard_lookup": sharding.op10_shard_lookup,
    "op11_turn_repair": conversations.op11_turn_repair,
    "op12_zone_clusters": zones.op12_zone_clusters,
    "op13_line_bitmaps": lines.op13_line_bitmaps,
}

ORACLES: dict[str, str] = {
    "op1_warc_chunks": warc.ORACLE,
    "op3_secret_trigrams": secrets.oracle(),
    "op4_substring_anchors": substrings.ORACLE,
    "op11_turn_repair": conversations.ORACLE,
    "op12_zone_clusters": zones.ORACLE,
    "op13_line_bitmaps": lines.ORACLE,
}
