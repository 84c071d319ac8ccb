"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from platewise.llm.bpe import op6_byte_bpe
from platewise.llm.chat import op7_chat
from platewise.llm.context_tree import op11_context_tree
from platewise.llm.decontam import op8_decontam
from platewise.llm.filter_audit import ORACLE as AUDIT_SQL
from platewise.llm.filter_audit import op12_filter_audit
from platewise.llm.jaccard import op2_jaccard
from platewise.llm.licenses import op5_licenses
from platewise.llm.merkle import op3_merkle
from platewise.llm.resample import op13_resample
from platewise.llm.sharding import op4_hilbert_shards
from platewise.llm.toxicity import op1_toxicity
from platewise.llm.url_filter import ORACLE as URL_SQL
from platewise.llm.url_filter import op10_url_filter
from platewise.llm.wrapper import op9_wrapper

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard": op2_jaccard,
    "op3_merkle": op3_merkle,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_licenses": op5_licenses,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat": op7_chat,
    "op8_decontam": op8_decontam,
    "op9_wrapper": op9_wrapper,
    "op10_url_filter": op10_url_filter,
    "op11_context_tree": op11_context_tree,
    "op12_filter_audit": op12_filter_audit,
    "op13_resample": op13_resample,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op10_url_filter": URL_SQL, "op12_filter_audit": AUDIT_SQL}
