"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from . import asof_queries, decision_queries, scoring_queries

MODULES = [asof_queries, decision_queries, scoring_queries]


def steady(sql: str) -> str:
    """Adds 1e-9 inside every round(x, n): values that lie halfway round alike in both engines."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, 0
        while depth:
            depth += (sql[j] == "(") - (sql[j] == ")")
            if depth == 1 and sql[j] == ",":
                comma = j
            j += 1
        out += sql[at:i] + "round((" + steady(sql[i + 6 : comma]) + ") + 1e-9" + sql[comma:j]
        at = j
    return out + sql[at:]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: steady(v) for m in MODULES for k, v in m.SQL.items()}
