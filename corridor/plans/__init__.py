"""Registered queries: each module has QUERIES and, where SQL can express them, ORACLES."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("gap", "pixel", "network", "embedding", "profile", "detect", "chips", "flow", "detectors", "tiles")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
