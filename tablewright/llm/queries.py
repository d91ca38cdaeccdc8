"""The corpus queries and the SQL that checks them."""

from __future__ import annotations

from tablewright.llm import (
    chat_snapshots,
    decontaminate,
    importance_resampling,
    interaction_audit,
    language_model,
    main_text,
    nearest,
    ngram_join,
    sentencepiece_codec,
    simhash_dedup,
    token_files,
    toxicity,
    url_filters,
)
from tablewright.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language_model": language_model.op3_language_model,
    "op4_chat_snapshots": chat_snapshots.op4_chat_snapshots,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_main_text": main_text.op6_main_text,
    "op7_nearest": nearest.op7_nearest,
    "op8_simhash": simhash_dedup.op8_simhash,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_token_files": token_files.op10_token_files,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_interaction_audit": interaction_audit.op12_interaction_audit,
    "op13_resampling": importance_resampling.op13_resampling,
}

ORACLES = {
    "op1_url_filters": " ".join(url_filters.OP1_SQL.split()),
    "op4_chat_snapshots": " ".join(chat_snapshots.OP4_SQL.split()),
    "op12_interaction_audit": " ".join(interaction_audit.OP12_SQL.split()),
}
