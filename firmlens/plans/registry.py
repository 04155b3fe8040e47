"""Where queries and their checking SQL are declared side by side."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlens.plans.oracle_views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` with the named view definitions (and what they need)."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEW_SQL[name]
        for need in needs.split():
            add(need)
        if name not in ordered:
            ordered.append(name)

    for v in views.split():
        add(v)
    ctes = [f"{v} AS ({VIEW_SQL[v][1]})" for v in ordered]
    body = body.strip()
    recursive = body.upper().startswith("RECURSIVE ")
    if recursive:
        body = body[len("RECURSIVE "):]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("SELECT"):
        return body if not ctes else head + ",\n".join(ctes) + "\n" + body
    return head + ",\n".join(ctes + [body])


def query(name: str, views: str = "", sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return register
