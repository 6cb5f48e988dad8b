"""All registered queries, by name: the plan, and the SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_FAMILIES = ("retrieval", "evidence", "reports", "statistics", "guards", "casework", "cases", "files", "streams")


def all_queries() -> dict[str, tuple[Callable, str | None]]:
    found: dict[str, tuple[Callable, str | None]] = {}
    for family in _FAMILIES:
        found |= import_module(f".{family}", __name__).QUERIES
    return found
