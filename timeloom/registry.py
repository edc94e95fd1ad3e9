"""All queries of the library with their SQL."""

from __future__ import annotations

import importlib

from timeloom.plans.catalog import ORACLES, QUERIES

MODULES = ["operators.intervals", "operators.projections", "operators.aggregates", "operators.windows", "operators.candidates", "operators.editorial", "operators.lexicon", "operators.vision", "operators.camera", "operators.projects", "operators.scalars", "streaming.progress"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"timeloom.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
