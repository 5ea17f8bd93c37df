"""Query catalogue over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from tarnwell.plans import assembly, evaluation, facts, lexical, streams, structures, traces, verification

MODULES = [lexical, verification, facts, evaluation, traces, structures, assembly, streams]


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
