"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from quire.llm import language_model, line_dedup, mixing, nearest, ngram_join, packing, personal, quotation, toxicity, vector_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_source_mixing": mixing.query,
    "op3_personal_data": personal.query,
    "op4_nearest": nearest.query,
    "op5_quotation": quotation.query,
    "op6_ngram_join": ngram_join.query,
    "op7_packing": packing.query,
    "op8_language_model": language_model.query,
    "op9_toxicity": toxicity.query,
    "op10_vector_dedup": vector_dedup.query,
}
SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_source_mixing": mixing.SQL,
    "op5_quotation": quotation.SQL,
}
