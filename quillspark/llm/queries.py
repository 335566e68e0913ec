"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_decontamination": "op01_decontamination",
    "op2_html": "op02_html",
    "op3_tiff": "op03_tiff",
    "op4_license": "op04_license",
    "op5_sharding": "op05_sharding",
    "op6_toxicity": "op06_toxicity",
    "op7_urls": "op07_urls",
    "op8_simhash": "op08_simhash",
    "op9_packing": "op09_packing",
    "op10_quality": "op10_quality",
    "op11_search": "op11_search",
    "op12_runs": "op12_runs",
    "op13_pii": "op13_pii",
}


def queries() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None):
            out[name] = sql
    return out
