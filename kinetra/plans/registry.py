"""All queries of the library but those of the corpus operators, with their DuckDB equivalents."""

from __future__ import annotations

from kinetra.plans import detection, grid, operations, platform, routes, services, state, streams

FAMILIES = (detection, grid, state, operations, routes, streams, platform, services)


def queries():
    return {name: run for family in FAMILIES for name, (run, _) in family.QUERIES.items()}


def oracle_sql():
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
