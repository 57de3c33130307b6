"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.sources.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def near(sql: str) -> str:
    """``round(x, n)`` written as ``rounded`` does it: what lies halfway goes up, with room for the last bits."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, -1, begin + 6
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            comma = i if c == "," and depth == 1 else comma
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out += f"{sql[at:begin]}(floor(({near(sql[begin + 6 : comma])}) * 1e{digits} + 0.5000001) / 1e{digits})"
        at = i
    return out + sql[at:]


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name.

    ``sql``: DuckDB SQL for the same rows, without ``WITH``; further common
    table expressions come before ``SELECT`` as ``, name AS (...)``.
    """

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = near(f"{with_views(*views)}\n{sql}" if views else sql.strip())
        return f

    return add
