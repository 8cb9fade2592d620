"""Training-data queries and their SQL, by name."""

from __future__ import annotations

import importlib

_MODULES = (
    "splitting",
    "consensus",
    "truncation",
    "pairs",
    "lookalikes",
    "alignment",
    "encoding",
    "mixing",
    "residue",
)


def _modules():
    return [importlib.import_module(f"quireloom.llm.{name}") for name in _MODULES]


def queries():
    return {k: q for module in _modules() for k, q in module.QUERIES.items()}


def oracle_sql():
    return {k: q for module in _modules() for k, q in getattr(module, "SQL", {}).items()}
