"""Queries of the core library and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

PLANS = ("slice", "text", "graph", "measures", "search", "topology", "building", "analysis", "segments", "elements", "retrieval", "metrics", "layers")


def _plans() -> list:
    return [importlib.import_module(f"lodestrata.plans.{name}") for name in PLANS]


def queries() -> dict[str, Callable]:
    return {name: run for plan in _plans() for name, run in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.ORACLES.items()}
