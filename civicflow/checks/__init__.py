"""Every operator and job on the driver's tables, beside the same thing in SQL."""

from __future__ import annotations

from importlib import import_module

from civicflow.checks.registry import ORACLES, QUERIES

_MODULES = ["relational", "columns", "geocoding", "jobs", "binary", "files"]


def all_checks() -> tuple[dict, dict]:
    """(queries, oracles) by name."""
    for module in _MODULES:
        import_module(f"civicflow.checks.{module}")
    return dict(QUERIES), dict(ORACLES)
