"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_packing": "op1",
    "op2_chat": "op2",
    "op3_neardup": "op3",
    "op4_decontamination": "op4",
    "op5_media": "op5",
    "op6_lm_scoring": "op6",
    "op7_secrets": "op7",
    "op8_sharding": "op8",
    "op9_warc": "op9",
    "op10_toxicity": "op10",
}


def queries() -> dict:
    return {name: import_module(f".{module}", __package__).query for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in NAMES.items():
        sql = getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
