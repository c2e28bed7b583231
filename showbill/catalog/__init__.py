"""Registered queries, each with the DuckDB statement it is compared with."""

from __future__ import annotations

from importlib import import_module

from showbill.catalog.base import REGISTRY

MODULES = (
    "grouping",
    "normalize",
    "text",
    "review",
    "filters",
    "joins",
    "rollups",
    "ranking",
    "generators",
    "sources",
    "sinks",
    "quality",
    "streams",
    "plans",
)


def load() -> dict:
    """Import every query module and return name -> (function, sql or None)."""
    for name in MODULES:
        import_module(f"showbill.catalog.{name}")
    return REGISTRY
