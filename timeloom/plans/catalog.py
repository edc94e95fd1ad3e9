"""Queries by name: a function of tables and fixtures, and the SQL that gives the same rows."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeloom.sources.fixtures import FIXTURES, fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def exact(sql: str) -> str:
    """Decimal literals outside quotes as doubles, which both engines then treat alike."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for i, p in enumerate(parts))


def with_fixtures(sql: str, engine: int) -> str:
    """SQL with the fixtures it names put before it as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in FIXTURES and name not in order:
                need(FIXTURES[name][engine])
                order.append(name)

    need(sql)
    head = ", ".join(f"{n} as ({FIXTURES[n][engine]})" for n in order)
    body = sql.strip()
    m = re.match(r"with\s+(recursive\s+)?", body)
    if not head:
        return exact(re.sub(r"^with\s+(?!recursive)", "with recursive ", body) if m else body)
    return exact(f"with recursive {head}" + (", " + body[m.end() :] if m else " " + body))


def query(name: str, sql: str | None = None):
    """Register a function whose parameters name the tables (or ``fx_`` fixtures) that it gets as DataFrames."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        needs = list(inspect.signature(f).parameters)
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, n) for n in needs])
        if sql:
            ORACLES[name] = with_fixtures(sql, 1)
        return f

    return add
