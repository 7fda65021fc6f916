"""Operators for preparing training corpora; nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = (
    "op01_language",
    "op02_warc",
    "op03_substrings",
    "op04_licences",
    "op05_secrets",
    "op06_nearest",
    "op07_jaccard",
    "op08_packing",
    "op09_quality",
    "op10_decontamination",
)


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
