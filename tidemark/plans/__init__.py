"""Registered queries and their SQL equivalents."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark.plans.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name != "registry":
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
