"""All queries over the driver tables, and their SQL."""

from __future__ import annotations

from . import corpus, kernels, scoring, series, signals

MODULES = (signals, series, scoring, corpus, kernels)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
