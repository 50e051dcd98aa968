"""All checked queries, one module per part of the inventory."""

from __future__ import annotations

import importlib

from furlong.verify.base import ORACLE, QUERIES

_PARTS = (
    "windows",
    "sources",
    "scalars",
    "joins",
    "stats",
    "lookup",
    "quality",
    "modelling",
    "betting",
    "analysis",
    "streaming",
)

for _part in _PARTS:
    importlib.import_module(f"furlong.verify.{_part}")

__all__ = ["ORACLE", "QUERIES"]
