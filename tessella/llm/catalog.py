"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["jaccard", "quality", "spans", "chat", "fingerprints", "licenses", "tokens", "decontamination", "pieces", "merkle", "toxicity", "collocations"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"tessella.llm.q_{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
