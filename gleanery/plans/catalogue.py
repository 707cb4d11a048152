"""Loads every catalogue module and hands out the registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ["records", "selection", "aggregates", "activity", "search"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"gleanery.plans.{name}")
    return QUERIES, ORACLES
