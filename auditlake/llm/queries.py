"""Registered queries of the ten training-data operators; each applies its operator to the whole table."""

from __future__ import annotations

import importlib

#: query name -> (module, function, name of the SQL text or None)
_OPS = {
    "op1_exact_dedup": ("exact_dedup", "op1", "OP1_SQL"),
    "op2_sentencepiece": ("sentencepiece_codec", "op2", None),
    "op3_suffix_array_dedup": ("suffix_dedup", "op3", None),
    "op4_secret_scan": ("secret_scan", "op4", None),
    "op5_warc": ("warc_archive", "op5", "OP5_SQL"),
    "op6_quality_classifier": ("quality_classifier", "op6", None),
    "op7_decontamination": ("decontamination", "op7", None),
    "op8_minhash_near_dedup": ("near_dedup", "op8", None),
    "op9_substring_dedup": ("substring_dedup", "op9", None),
    "op10_chat_format": ("chat_format", "op10", None),
}


def _load(name: str):
    module, function, sql = _OPS[name]
    m = importlib.import_module(f"auditlake.llm.{module}")
    return getattr(m, function), getattr(m, sql) if sql else None


def queries() -> dict:
    return {name: _load(name)[0] for name in _OPS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _OPS if (sql := _load(name)[1])}
