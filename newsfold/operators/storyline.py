"""Stories as arrays of typed blocks: (story_id, storyline array<struct<type, data string>>), data being JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEMS = "array<struct<type: string, data: struct<text: string, href: string, annotations: map<string, boolean>>>>"


def parse_story_payload(stubs: DataFrame, payload: str = "payload") -> DataFrame:
    """stubs with what the story reply says: title, times, labels and text; ``ok`` false or no text keeps the stub."""
    schema = """ok boolean, data struct<meta: struct<id: string, headline: string, published_at: string, updated_at: string, access_level: string, advertiser: string>,
        storyline: array<struct<type: string, data: string>>>"""
    r = stubs.withColumn("__p", F.from_json(payload, schema))
    m = "__p.data.meta"
    r = r.withColumn("__text", storyline_text(F.col("__p.data.storyline")))
    good = F.coalesce(F.col("__p.ok"), F.lit(False)) & (F.coalesce("__text", F.lit("")) != "")
    none = F.array().cast("array<string>")
    labels = F.array_union("labels", F.array_union(F.when(F.coalesce(f"{m}.access_level", F.lit("free")) != "free", F.array(F.lit("paywalled"))).otherwise(none), F.when(F.col(f"{m}.advertiser").isNotNull(), F.array(F.lit("sponsored"))).otherwise(none)))

    def take(c: str, new: Column) -> Column:
        return F.when(good, F.coalesce(new, F.col(c))).otherwise(F.col(c)).alias(c)

    new = {"title": F.nullif(F.col(f"{m}.headline"), F.lit("")), "created_at": F.try_to_timestamp(f"{m}.published_at"), "updated_at": F.try_to_timestamp(f"{m}.updated_at"), "labels": labels, "text": F.col("__text")}
    return r.select(*[take(c, new[c]) if c in new else F.col(c) for c in stubs.columns], *([] if "text" in stubs.columns else [F.when(good, F.col("__text")).alias("text")]))


def _items(data: Column) -> Column:
    return F.from_json(F.get_json_object(data, "$.items"), ITEMS)


def storyline_text(blocks: Column) -> Column:
    """The plain text: ingress, rich text, quotes with their attribution; other blocks are skipped."""

    def said(b: Column) -> Column:
        t, d = b["type"], b["data"]
        quote = F.concat_ws("\n", F.concat(F.lit('"'), F.get_json_object(d, "$.text"), F.lit('"')), F.concat(F.lit("— "), F.get_json_object(d, "$.attribution")))
        rich = F.array_join(F.transform(F.filter(_items(d), lambda i: i["type"] == "text"), lambda i: i["data"]["text"]), "")
        return F.when(t == "header", F.get_json_object(d, "$.ingress")).when(t == "rich_text", rich).when(t.isin("quote", "block_quote"), quote)

    return F.array_join(F.filter(F.transform(blocks, said), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def storyline_markdown(blocks: Column) -> Column:
    """Markdown: headings of level 1 to 6, rich text with links and upper-case items, quotes, images; adverts are skipped."""

    def item(i: Column) -> Column:
        text = i["data"]["text"]
        text = F.when(F.coalesce(F.try_element_at(i["data"]["annotations"], F.lit("uppercase")), F.lit(False)), F.upper(text)).otherwise(text)
        return F.when((i["type"] == "link") & i["data"]["href"].isNotNull(), F.concat(F.lit("["), text, F.lit("]("), i["data"]["href"], F.lit(")"))).otherwise(text)

    def said(b: Column) -> Column:
        t, d = b["type"], b["data"]
        level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.get_json_object(d, "$.level").cast("int"), F.lit(2))))
        heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.get_json_object(d, "$.text"))
        header = F.concat_ws("\n\n", F.concat(F.lit("# "), F.get_json_object(d, "$.headline")), F.get_json_object(d, "$.ingress"))
        image = F.concat(F.lit("!["), F.coalesce(F.get_json_object(d, "$.caption"), F.lit("")), F.lit("]("), F.get_json_object(d, "$.url"), F.lit(")"))
        return (
            F.when(t == "header", header).when(t == "heading", heading).when(t == "rich_text", F.array_join(F.transform(_items(d), item), ""))
            .when(t.isin("quote", "block_quote"), F.concat(F.lit("> "), F.get_json_object(d, "$.text"))).when(t == "image", image)
            .when(t == "ad_container", F.lit(None)).otherwise(F.concat(F.lit("<!-- "), t, F.lit(" -->")))
        )

    return F.array_join(F.filter(F.transform(blocks, said), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def local_times(stories: DataFrame, said: Column) -> DataFrame:
    """stories with ``times``: the local texts of their times, repeats removed."""
    return stories.withColumn("times", F.array_distinct(said))
