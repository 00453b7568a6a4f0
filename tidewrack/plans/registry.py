"""All queries of the library and their SQL."""

from __future__ import annotations

from tidewrack.plans import daily, digest, flows, publish, reports, state, text

MODULES = (text, digest, state, flows, reports, daily, publish)


def flagship(spark, sf_dir: str):
    return digest.round_robin(spark, sf_dir)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
