"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query name, module, whether SQL states the same result
LIST = (
    ("op1_mixing", "mixing"),
    ("op2_warc", "warc"),
    ("op3_toxicity", "toxicity"),
    ("op4_substring_dedup", "substring_dedup"),
    ("op5_minhash", "minhash"),
    ("op6_fingerprint", "fingerprint"),
    ("op7_url_filter", "url_filter"),
    ("op8_quality", "quality"),
    ("op9_packing", "packing"),
    ("op10_exact_dedup", "exact_dedup"),
    ("op11_spelling", "spelling"),
    ("op12_vector_codes", "vector_codes"),
    ("op13_nearest", "nearest"),
)


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in LIST}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None) for name, module in LIST}
    return {name: sql for name, sql in found.items() if sql}
