"""Names of the library's queries, their functions and their SQL."""

from __future__ import annotations

import importlib

#: Modules of plumbline.plans that hold QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("text", "retrieval", "attribution", "models", "stats", "data", "annotation", "experiments", "challenges", "stores", "comparisons", "pilots")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"plumbline.plans.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
