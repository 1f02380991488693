"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_hmm": "op01_hmm",
    "op2_line_rules": "op02_line_rules",
    "op3_near_duplicates": "op03_near_duplicates",
    "op4_suffix_dedup": "op04_suffix_dedup",
    "op5_revisits": "op05_revisits",
    "op6_toxicity": "op06_toxicity",
    "op7_decontamination": "op07_decontamination",
    "op8_sentencepiece": "op08_sentencepiece",
    "op9_language_id": "op09_language_id",
    "op10_licenses": "op10_licenses",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of each operator that SQL can express; the others are held against brute force in tests/llm."""
    found = {}
    for name, module in _QUERIES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
