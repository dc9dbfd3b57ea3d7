"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: module, query
_QUERIES = [
    ("substring_dedup", "op1_substring_dedup"),
    ("exact_dedup", "op9_exact_dedup"),
    ("suffix_dedup", "op8_suffix_dedup"),
    ("sharding", "op2_sharding"),
    ("mixing", "op3_mixing"),
    ("license_scan", "op4_license_scan"),
    ("line_quality", "op5_line_quality"),
    ("quality_classifier", "op6_quality_classifier"),
    ("simhash", "op7_simhash"),
    ("sentencepiece_codec", "op10_sentencepiece"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import exact_dedup, license_scan, line_quality

    return {"op4_license_scan": license_scan.ORACLE, "op5_line_quality": line_quality.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
