"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from tidemark.queries.registry import ORACLES, QUERIES

_MODULES = (
    "sources", "cleaning", "scalars", "windows", "joins", "aggregates", "sets",
    "checks", "backtests", "models", "scores", "serving", "composites", "streams",
)

for _name in _MODULES:
    import_module(f"tidemark.queries.{_name}")

__all__ = ["QUERIES", "ORACLES"]
