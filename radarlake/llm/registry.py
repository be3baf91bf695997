"""The opN queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name -> module; modules are imported when a query runs.
MODULES = {
    "op1_decontamination": "op1_decontaminate",
    "op2_substring_dedup": "op2_substrings",
    "op3_bpe": "op3_bpe",
    "op4_main_text": "op4_wrappers",
    "op5_simhash": "op5_simhash",
    "op6_language_id": "op6_language",
    "op7_token_counts": "op7_token_tree",
    "op8_license_scan": "op8_licenses",
    "op9_toxicity": "op9_toxicity",
    "op10_topk_search": "op10_topk",
}


def _late(module: str):
    def run(spark, sf_dir):
        return importlib.import_module(f"radarlake.llm.{module}").query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _late(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"radarlake.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
