"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("registry", "spatial", "p1", "p3", "p4", "p6", "p7")


def registered() -> tuple[dict[str, Callable], dict[str, str]]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        m = importlib.import_module(f"terrane.queries.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
