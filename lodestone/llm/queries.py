"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.alignment import op12_tokenizer_alignment
from lodestone.llm.chat_format import OP11_SQL, op11_chat_formatting
from lodestone.llm.exact_topk import OP8_SQL, op8_exact_topk
from lodestone.llm.filter_audit import OP13_SQL, op13_filter_audit
from lodestone.llm.jaccard_join import OP4_SQL, op4_ngram_jaccard_join
from lodestone.llm.katz import op7_lm_scoring
from lodestone.llm.mixing import op9_mixing
from lodestone.llm.piece_sampling import op1_sentencepiece_sampling
from lodestone.llm.quality_fm import op5_quality_classifier
from lodestone.llm.secret_scan import op2_secret_scans
from lodestone.llm.spotsigs import op10_document_fingerprints
from lodestone.llm.suffix_dedup import op3_suffix_dedup
from lodestone.llm.toxicity import op6_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_sentencepiece_sampling": op1_sentencepiece_sampling,
    "op2_secret_scans": op2_secret_scans,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_exact_topk": op8_exact_topk,
    "op9_mixing": op9_mixing,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": OP4_SQL,
    "op8_exact_topk": OP8_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
