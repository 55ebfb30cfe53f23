"""The queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from coloom.llm import ann, chat, decontaminate, language, lm, negatives, packing, pieces, pii, prefixes, repeats, secrets, simhash

QUERIES = {
    "op1_nearest_neighbours": ann.op1_nearest_neighbours,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_substring_dedup": repeats.op3_substring_dedup,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_chat_format": chat.op6_chat_format,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_personal_data": pii.op8_personal_data,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_language_id": language.op10_language_id,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_prefixes": prefixes.op12_conversation_prefixes,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_substring_dedup": repeats.OP3_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op8_personal_data": pii.sql(),
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_conversation_prefixes": prefixes.OP12_SQL,
}
