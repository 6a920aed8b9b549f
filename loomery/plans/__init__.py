"""Registered queries: library operators bound to the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """(queries, sql twins) of every module in this package."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from loomery.plans.registry import QUERIES, SQL

    return QUERIES, SQL
