"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "op1_fingerprints",
    "op2_pii",
    "op3_substring_dedup",
    "op4_licenses",
    "op5_quality",
    "op6_decontaminate",
    "op7_source_mix",
    "op8_url_filter",
    "op9_simhash_dedup",
    "op10_masked_lm",
]


def queries() -> dict:
    mods = [import_module(f"tarnwell.llm.{m}") for m in MODULES]
    return {m.NAME: m.query for m in mods}


def oracle_sql() -> dict[str, str]:
    mods = [import_module(f"tarnwell.llm.{m}") for m in MODULES]
    return {m.NAME: m.ORACLE_SQL for m in mods if getattr(m, "ORACLE_SQL", None)}
