"""Queries over the synthetic tables, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["camera", "grid", "time", "raster", "match", "io", "files", "tracking"]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").ORACLE
    return out
