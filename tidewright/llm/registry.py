"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tidewright.llm import bpe, chat_format, decontaminate, quality, repeats, resample, set_join, sharding, source_mix, toxicity, url_filter, vector_code, vector_search

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_decontaminate": decontaminate.query,
    "op3_set_join": set_join.query,
    "op4_url_filter": url_filter.query,
    "op5_vector_search": vector_search.query,
    "op6_sharding": sharding.query,
    "op7_toxicity": toxicity.query,
    "op8_source_mix": source_mix.query,
    "op9_repeats": repeats.query,
    "op10_quality": quality.query,
    "op11_vector_code": vector_code.query,
    "op12_resample": resample.query,
    "op13_bpe": bpe.query,
}

SQL = {
    "op1_chat_format": chat_format.SQL,
    "op8_source_mix": source_mix.SQL,
    "op11_vector_code": vector_code.SQL,
    "op12_resample": resample.SQL,
}
