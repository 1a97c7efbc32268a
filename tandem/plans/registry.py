"""Registry of queries: one Spark query and, where SQL can say it, one checking SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandem.plans.fixtures import BASE_TABLES, VIEWS, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# views that only the checking SQL uses
CHECK_VIEWS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def check_view(name: str, sql: str) -> None:
    if name in CHECK_VIEWS:
        raise ValueError(f"view {name} is registered twice")
    CHECK_VIEWS[name] = sql


def _names_in(sql: str) -> list[str]:
    found = re.findall(r"\b([fo]_[a-z0-9_]+)\b", sql)
    return [n for n in dict.fromkeys(found) if n in VIEWS or n in CHECK_VIEWS]


def full_oracle(sql: str) -> str:
    """Prefix the checking SQL with the views it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _names_in(text):
            if name not in ordered:
                visit(body(name))
                ordered.append(name)

    def body(name: str) -> str:
        text = VIEWS.get(name) or CHECK_VIEWS[name]
        for other in [*BASE_TABLES, *VIEWS]:
            text = text.replace("{" + other + "}", other)
        return text

    visit(sql)
    ctes = [f"{n} AS ({body(n)})" for n in ordered]
    stripped = sql.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*ctes, stripped[len("WITH RECURSIVE"):]])
    if stripped.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, stripped[len("WITH "):]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + stripped


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}
