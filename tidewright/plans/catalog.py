"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import dependencies, flows, graphs, ledger, predicates, reporting, resolution, scans

_MODULES = (dependencies, flows, graphs, ledger, predicates, reporting, resolution, scans)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
