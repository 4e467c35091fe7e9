"""Registration of named queries."""

from __future__ import annotations

from seqrank.catalog.inputs import Inputs
from seqrank.session import share_code

QUERIES: dict = {}
SQL: dict[str, str] = {}


def steady(sql: str) -> str:
    """Give every ``round(x,6)`` and ``round(x,9)`` of a SQL twin the nudge that the Spark side uses."""
    out, at = [], 0
    while True:
        start = sql.find("round(", at)
        if start < 0:
            return "".join(out) + sql[at:]
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = steady(sql[start + 6 : end - 1])
        for digits in (6, 9):
            if inner.endswith(f",{digits}"):
                inner = f"({inner[:-2]})+1.234e-{digits + 5},{digits}"
        out += [sql[at:start], "round(", inner, ")"]
        at = end


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Inputs`; ``sql`` is its DuckDB twin."""

    def keep(fn):
        def run(spark, folder):
            share_code(spark)
            return fn(Inputs(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = steady(sql)
        return fn

    return keep
