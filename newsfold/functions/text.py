"""Text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Without [12] citations, /* section */ marks and control characters, and without a space before . , ; : ! ? )."""
    c = F.regexp_replace(c, r"\[[0-9]+\]", "")
    c = F.regexp_replace(c, r"/\* .*? \*/", "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(c, r" +([.,;:!?)])", "$1")


def _nfkc(title: pd.Series) -> pd.Series:
    return title.map(lambda t: unicodedata.normalize("NFKC", t).strip() if isinstance(t, str) else "")


def normalize_title(title: Column) -> Column:
    """Trimmed and in NFKC; null is empty. In batches of Arrow, since Spark has no such function."""
    return F.pandas_udf(_nfkc, "string")(title)


def title_suspicious(title: Column) -> Column:
    """Whether the normal form differs from the title."""
    return normalize_title(title) != F.coalesce(title, F.lit(""))


def sentences(text: Column) -> Column:
    """By line, then after . ! ? before a space; trimmed, without empty ones."""
    lines = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")


def local_time_text(ts: Column, now: Column, zone: str = "Europe/Helsinki") -> Column:
    """A UTC time as today or yesterday with the hour, or as the date with the hour, in the zone's time."""
    here, today = F.from_utc_timestamp(ts, zone), F.from_utc_timestamp(now, zone)
    days = F.datediff(F.to_date(today), F.to_date(here))
    hour = F.date_format(here, "HH:mm")
    return F.when(days == 0, F.concat(F.lit("today "), hour)).when(days == 1, F.concat(F.lit("yesterday "), hour)).otherwise(F.date_format(here, "dd.MM.yyyy HH:mm"))
