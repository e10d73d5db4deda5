"""Query registry: name, inventory rows covered, Spark callable, SQL check."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from annalist.plans.bindings import SQL_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(tables)``. ``sql`` may use the views in SQL_VIEWS."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, expand_views(sql) if sql else None)
        return build

    return wrap


def expand_views(sql: str) -> str:
    """Prefix ``sql`` with the logical views it uses, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    body = sql.strip()
    recursive = bool(re.match(r"(?is)with\s+recursive\b", body))
    ctes = [f"{name} AS ({SQL_VIEWS[name]})" for name in SQL_VIEWS if name in needed]
    if not ctes:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    if re.match(r"(?is)with\b", body):
        body = re.sub(r"(?is)^with\s+(recursive\s+)?", "", body)
        return head + ",\n".join(ctes) + ",\n" + body
    return head + ",\n".join(ctes) + "\n" + body


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bind(item.build) for name, item in REGISTRY.items()}


def check_sql() -> dict[str, str]:
    return {name: item.sql for name, item in REGISTRY.items() if item.sql}
