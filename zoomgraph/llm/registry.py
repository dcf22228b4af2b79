"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module that holds the function of that name.
MODULES = {
    "op1_fingerprint": "fingerprint",
    "op2_ngram_join": "ngram_join",
    "op3_language": "language",
    "op4_sharding": "sharding",
    "op5_lm": "lm",
    "op6_substrings": "substrings",
    "op7_decontaminate": "decontaminate",
    "op8_mixing": "mixing",
    "op9_secrets": "secrets",
    "op10_token_counts": "token_counts",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, m in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{m}"), f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            out[name] = sql
    return out
