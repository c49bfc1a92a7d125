"""Queries over the given tables, a function and its SQL for each."""

from . import aggregates, assembled, composed, compounded, evaluated, further, joined, landed, modelled, scalars, windowed

MODULES = [aggregates, windowed, joined, scalars, landed, evaluated, compounded, composed, modelled, further, assembled]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
