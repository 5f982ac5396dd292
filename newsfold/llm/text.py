"""Text as the corpus operators see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def body(text: str = "text") -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids in ``dropped`` (a written table of one id column).

    The ids go to the documents where they are few (their number is checked); else both sides shuffle by id.
    Rows with a null id stay.
    """
    from newsfold.functions.runtime import free_name, small

    key = free_name(docs, "__id")
    return docs.join(small(dropped.select(F.col(dropped.columns[0]).alias(key))), F.col(id_col) == F.col(key), "left_anti")
