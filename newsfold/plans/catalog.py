"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsfold.plans import core, documents, feeds, pages, titles, wiki

Query = Callable[[SparkSession, str], DataFrame]
_ALL = core.QUERIES | pages.QUERIES | documents.QUERIES | titles.QUERIES | wiki.QUERIES | feeds.QUERIES


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
