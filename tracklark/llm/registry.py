"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontamination", "sharding", "secrets", "licenses", "language", "vectors", "packing", "wordpieces", "jaccard", "chat", "codes", "ranked", "minhash")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"tracklark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
