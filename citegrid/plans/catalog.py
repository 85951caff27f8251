"""The registered queries over the shared tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citegrid.plans import constraints, corpora, graphs, ledgers, scores, sources, streams, texts, traces

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (graphs, constraints, traces, scores, texts, corpora, ledgers, sources, streams)


def queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
