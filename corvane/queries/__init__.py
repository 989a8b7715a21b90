"""Named queries over the corpus tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.model import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of :class:`Tables` under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


from corvane.queries import admission, analytics, conversations, enrichment, indexed, indexing, jobs, labels, lifecycle, messages, provenance, reconciling, relational, said, search, sources, structured, upkeep  # noqa: E402, F401
