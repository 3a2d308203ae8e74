"""Importing this module fills the registry."""

from parcelflow.llm import (  # noqa: F401
    op1_substring_dedup,
    op2_html_extraction,
    op3_language_id,
    op4_sharding,
    op5_chat_format,
    op6_best_fit_packing,
    op7_quality_ranking,
    op8_simhash_golay,
    op9_decontaminate,
    op10_topk_search,
    op11_tokenizer_alignment,
    op12_compression_bands,
    op13_spelling_variants,
)
from parcelflow.llm.registry import ORACLE, QUERIES  # noqa: F401
