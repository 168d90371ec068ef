"""Registered queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.sources.corpus import SQL_VIEWS, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a Corpus. SQL may use the corpus's entities as views."""

    def register(build: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return register


def with_views(sql: str) -> str:
    """sql after the definitions of the entities that it names, directly or through others."""
    wanted: list[str] = []

    def need(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name, body in SQL_VIEWS.items():
            if name in words and name not in wanted:
                need(body)
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    defined = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in wanted)
    body = sql.strip()
    return f"WITH {defined}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {defined} {body}"
