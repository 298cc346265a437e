"""All queries of the core by name."""

from __future__ import annotations

from tidemark.plans import compositions, evaluation, further, general, joins, learning, ranking, supplement, telemetry, text

MODULES = (general, text, joins, ranking, evaluation, telemetry, supplement, compositions, further, learning)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
