"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("neardup", "quality", "licenses", "pii", "lines", "mixing", "bpe", "langid", "media", "extract", "pieces", "audit", "phrases")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"plumbline.llm.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
