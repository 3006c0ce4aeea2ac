"""All registered queries."""

from __future__ import annotations

import importlib

from deltion.catalog.base import ORACLES, QUERIES

MODULES = ["scalars", "scans", "states", "filtering", "linking", "aggregating", "ordering", "budgets", "incremental", "composites"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"deltion.catalog.{name}")
    return QUERIES, ORACLES
