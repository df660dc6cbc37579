"""Operators for training data: one module for each problem, each with its queries and SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = (
    "near_duplicates",
    "vector_neighbours",
    "answer_defects",
    "name_variants",
    "scan_repair",
    "split_oversized",
    "main_content",
    "token_ids",
    "eval_leaks",
    "mojibake",
)


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable]:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in getattr(module, "ORACLES", {}).items()}
