"""The queries of this subpackage under their registered names, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from threadlake.llm import chat, fill_middle, queries, threshold_search

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_recurrent_language_id": queries.op1_recurrent_language_id,
    "op2_perspective_rotation": queries.op2_perspective_rotation,
    "op3_bag_min_hash": queries.op3_bag_min_hash,
    "op4_weak_supervision": queries.op4_weak_supervision,
    "op5_tree_scoring": queries.op5_tree_scoring,
    "op6_warc_archives": queries.op6_warc_archives,
    "op7_n_best_pieces": queries.op7_n_best_pieces,
    "op8_threshold_algorithm": queries.op8_threshold_algorithm,
    "op9_conflict_packing": queries.op9_conflict_packing,
    "op10_information_sanitising": queries.op10_information_sanitising,
    "op11_pitman_yor": queries.op11_pitman_yor,
    "op12_block_repair": queries.op12_block_repair,
    "op13_repeated_captures": queries.op13_repeated_captures,
    "pipeline": corpus_pipeline.run,
}

LLM_ORACLE: dict[str, str] = {
    "op2_perspective_rotation": chat.SQL,
    "op8_threshold_algorithm": threshold_search.SQL,
    "op13_repeated_captures": fill_middle.SQL,
}
