"""All queries over the engine's own operators, with SQL for each where SQL can express it."""

from __future__ import annotations

from ravelin.plans import aggregates, feeds, filters, graphs, ingest, metrics, recipes, scans, searches, values  # noqa: F401
from ravelin.plans.registry import QUESTIONS, SQL


def queries() -> dict:
    return dict(QUESTIONS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
