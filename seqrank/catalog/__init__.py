"""Named queries over the shared test tables, with SQL twins."""

from __future__ import annotations

import importlib

TOPICS = ["windows", "scores", "ranking", "context", "jobs", "motifs", "evaluation", "audits", "files", "stateful"]


def _load():
    for topic in TOPICS:
        importlib.import_module(f"seqrank.catalog.{topic}")
    return importlib.import_module("seqrank.catalog.registry")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().SQL)
