"""Prompts, structured replies and the predictor plug-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import written
from newsfold.operators.catalogue import CLICKBAIT

TITLE_SCHEMA = "contemplator string, evidence struct<content: string, tone: string, structure: string>, original_title string, original_title_clickbaitiness string, title string"
MAX_RUNS = 5


def _think(reply: Column) -> Column:
    return F.trim(F.regexp_extract(reply, r"(?s)<think>(.*?)</think>", 1))


def reply_json(reply: Column) -> Column:
    """The JSON of a reply: its last fenced json block, else the reply without <think> parts; control characters removed."""
    fenced = F.regexp_extract_all(reply, F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    plain = F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))
    found = F.when(F.size(fenced) > 0, F.try_element_at(fenced, F.lit(-1))).otherwise(plain)
    return F.trim(F.regexp_replace(found, r"[\x00-\x1F\x7F]", " "))


def closed(text: Column) -> Column:
    """Cut-off JSON with its open string, arrays and objects closed, by their nesting."""
    bare = F.regexp_replace(F.regexp_replace(text, r'\\.', ""), r'"[^"]*"', "")
    odd = F.contains(bare, F.lit('"'))
    bare = F.regexp_replace(bare, '".*$', "")

    def step(open_: Column, c: Column) -> Column:
        return F.when(c == "{", F.concat(F.lit("}"), open_)).when(c == "[", F.concat(F.lit("]"), open_)).when(c.isin("}", "]"), F.substring(open_, 2, 1_000_000)).otherwise(open_)

    ends = F.aggregate(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), F.lit(""), step)
    return F.concat(F.when(odd, F.concat(text, F.lit('"'))).otherwise(F.regexp_replace(text, r"[,:]\s*$", "")), ends)


def parse_replies(replies: DataFrame, schema: str = TITLE_SCHEMA, scales: tuple[str, ...] = ("original_title_clickbaitiness",)) -> DataFrame:
    """replies with ``value`` (a struct of the schema) or ``error``: empty, invalid, or a wrong scale value.

    Cut-off JSON is closed; an empty ``contemplator`` is filled from the <think> part.
    """
    text = reply_json(F.col("reply"))
    rows = replies.withColumn("__text", text)
    whole = F.from_json("__text", schema, {"mode": "PERMISSIVE"})
    mended = F.from_json(closed(F.col("__text")), schema, {"mode": "PERMISSIVE"})
    first = schema.split()[0]
    blank = F.coalesce("__text", F.lit("")) == ""
    rows = rows.withColumn("__whole", F.try_parse_json("__text").isNotNull()).withColumn("__mended", F.try_parse_json(closed(F.col("__text"))).isNotNull())
    rows = rows.withColumn("value", F.when(F.col("__whole"), whole).when(F.col("__mended"), mended))
    if "contemplator" in schema:
        rows = rows.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value").withField("contemplator", F.coalesce(F.nullif(F.col("value.contemplator"), F.lit("")), F.nullif(_think(F.col("reply")), F.lit(""))))))
    wrong = F.lit(False)
    for s in scales:
        wrong |= F.coalesce(~F.col(f"value.{s}").isin(*CLICKBAIT), F.lit(True))
    last = F.col("value").getField(schema.rsplit(",", 1)[-1].split()[0])
    error = F.when(blank, "empty").when(F.col("value").isNull(), "invalid").when(F.col(f"value.{first}").isNull() & last.isNull(), "invalid").when(wrong, "scale")
    rows = rows.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), F.col("value")))
    return rows.drop("__text", "__whole", "__mended")


def _plain(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]*>", "")
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _indent(c: Column) -> Column:
    return F.concat(F.lit("    "), F.replace(c, F.lit("\n"), F.lit("\n    ")))


def render_prompt(articles: DataFrame, schema: str = TITLE_SCHEMA) -> DataFrame:
    """articles with ``prompt``: title and text, the stored title if there is one, the reply's form, a failed reply's error.

    Columns read: title, text and, where present, old_title, old_level, reply, error.
    """
    has = set(articles.columns)
    parts = [
        F.concat(F.lit("Title: "), _plain(F.coalesce("title", F.lit("")))),
        F.concat(F.lit("Text:\n"), _indent(F.coalesce("text", F.lit("")))),
    ]
    if "old_title" in has:
        parts.append(F.when(F.coalesce("old_title", F.lit("")) != "", F.concat(F.lit("Stored title: "), _plain(F.col("old_title")), F.lit(" ("), F.coalesce("old_level", F.lit("unrated")), F.lit(")"))))
    parts.append(F.lit(f"Answer with JSON of this form: {schema}"))
    if {"reply", "error"} <= has:
        parts.append(F.when(F.col("error").isNotNull(), F.concat(F.lit("Your answer was:\n> "), F.replace(F.coalesce("reply", F.lit("")), F.lit("\n"), F.lit("\n> ")), F.lit("\nIt was not accepted: "), F.col("error"))))
    return articles.withColumn("prompt", F.concat_ws("\n\n", *parts))


def predict(articles: DataFrame, fn: Callable[[list[str]], list[str]], key: str = "article_id", schema: str = TITLE_SCHEMA, scales: tuple[str, ...] = ("original_title_clickbaitiness",), max_runs: int = MAX_RUNS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): what fn says to the articles' prompts, parsed; a failed reply is asked again with its error.

    fn maps a batch of prompts to replies. accepted has key, attempt and value; rejected has key, reply and error.
    """

    def ask(batches):
        for pdf in batches:
            pdf["reply"] = pd.Series(fn(list(pdf["prompt"])), index=pdf.index, dtype=object)
            yield pdf[["__key", "reply"]]

    keyed = articles.withColumn("__key", F.col(key))
    kind = articles.schema[key].dataType.simpleString()
    accepted, todo, failed = None, keyed, None
    for attempt in range(1, max_runs + 1):
        asked = render_prompt(todo, schema).select("__key", "prompt").mapInPandas(ask, f"__key {kind}, reply string")
        got = written(parse_replies(asked, schema, scales))
        good = got.where("error is null").select(F.col("__key").alias(key), F.lit(attempt).alias("attempt"), "value")
        accepted = good if accepted is None else accepted.unionByName(good)
        failed = got.where("error is not null").select("__key", "reply", "error")
        if failed.isEmpty():
            break
        todo = keyed.join(failed, "__key")
    return accepted, failed.withColumnRenamed("__key", key)
