"""Registered queries: every one reads the given tables; most carry the SQL they must agree with."""

from __future__ import annotations

import importlib

from loreloom.plans.registry import ORACLES, QUERIES

MODULES = ("texts", "boards", "chunking", "subwords", "search", "ranking", "talk", "evaluate", "usage", "credit", "streams", "stores")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"loreloom.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
