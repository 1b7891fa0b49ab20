"""All registered queries of the core, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "multimodal", "corpus")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"quillon.queries.{m}").QUERIES
    return out


def oracles() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"quillon.queries.{m}").ORACLES
    return out
