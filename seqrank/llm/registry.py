"""Registration of this subpackage's queries and their DuckDB twins."""

from __future__ import annotations

from seqrank.session import share_code

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``sql`` is its twin."""

    def keep(fn):
        def run(spark, folder):
            share_code(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return keep
