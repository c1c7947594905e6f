"""Registry of the runnable queries, each with its DuckDB counterpart where plain SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchgrid.catalog.views import VIEWS, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the driver tables and to the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            return spark_view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _needed(sql: str) -> list[str]:
    """View names used by ``sql``, dependencies first."""
    seen: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for name in VIEWS:
            if name != skip and name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name], name)
                seen.append(name)

    visit(sql)
    return seen


def with_views(sql: str) -> str:
    body = sql.strip()
    names = _needed(body)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    m = re.match(r"WITH(\s+RECURSIVE)?\s+", body)
    if m:
        return f"WITH{m.group(1) or ''} {ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
