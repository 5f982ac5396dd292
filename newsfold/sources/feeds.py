"""Readers of feed payloads: XML feeds and sitemaps, JSON feeds, stories' and wiki replies. All give stubs.

A stub: pos, href, id, title, authors, language, outlet, text, created_at, updated_at, labels. Payloads are files; a
reader takes a path or paths. Broken records don't end a job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfold.functions.markup import Page
from newsfold.functions.runtime import written
from newsfold.operators.pages import page_links
from newsfold.operators.stubs import dedup_first_wins, require

STUB = ["href", "id", "title", "authors", "language", "outlet", "text", "created_at", "updated_at", "labels"]
_FEED = "title string, link string, description string, id string, guid string, author string, published string, pubDate string, content array<struct<_VALUE: string, _type: string, _language: string>>"
_MAP = "loc string, lastmod string, priority double, changefreq string, news struct<title: string, publication_name: string, publication_language: string, publish_date: string, keywords: array<string>>"
_LIST = "response array<struct<article_id: string, title: string, lead: string, service_name: string, category: struct<category_name: string>, published_at: string, updated_at: string, metadata: struct<sponsored_content: boolean, canonical_url: string>>>"
_STORY = "struct<id: string, headline: string, section: string, publication: string, published_at: string, updated_at: string, authors: array<struct<full_name: string>>, advertiser: struct<name: string>>"
_NESTED = f"ok boolean, data struct<groups: array<struct<children: array<struct<type: string, data: struct<stories: array<struct<data: struct<story: struct<data: {_STORY}>>>>>>>>>>"
_NONE = "array<string>"
EMPTY = "href string, id string, title string, authors array<string>, language string, outlet string, text string, created_at timestamp, updated_at timestamp, labels array<string>, pos long"


def parse_time(c: Column) -> Column:
    """ISO or mail-header time with its zone; null if neither."""
    mail = F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.try_to_timestamp(c), mail)


def _markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: Page(h).markdown() if isinstance(h, str) else None)


def _stub(df: DataFrame, **cols: Column) -> DataFrame:
    kinds = {"authors": _NONE, "labels": _NONE, "created_at": "timestamp", "updated_at": "timestamp"}
    return df.select(*[cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in STUB])


def read_feed_xml(spark: SparkSession, path, now: Column, language: str | None = None, row_tag: str = "item") -> DataFrame:
    """Stubs of the items of XML feeds (row_tag item or entry).

    The first content that isn't empty and is plain text or html beats the description; html becomes markdown. Items
    without a link go; without a readable date they count as of ``now``; without an id the link is the id.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(_FEED).load(path)
    good = F.get(F.filter("content", lambda c: (F.coalesce(c["_VALUE"], F.lit("")) != "") & F.coalesce(c["_type"], F.lit("text/plain")).isin("text/plain", "text/html")), F.lit(0))
    html = F.pandas_udf(_markdown, "string")(F.when(good["_type"] == "text/html", good["_VALUE"]))
    text = F.when(good["_type"] == "text/html", html).otherwise(F.coalesce(good["_VALUE"], F.col("description")))
    authors = F.filter(F.transform(F.split("author", ","), lambda a: F.trim(a)), lambda a: a != "")
    out = _stub(rows, href=F.trim("link"), id=F.coalesce("id", "guid", "link"), title=F.col("title"), authors=authors, language=F.lit(language), text=text, created_at=F.coalesce(parse_time(F.coalesce("published", "pubDate")), now), labels=F.array())
    return require(out, "href")


def read_sitemap_xml(spark: SparkSession, path, now: Column, language: str | None = None, outlet: str | None = None) -> DataFrame:
    """Stubs of sitemap entries; the news extension gives title, outlet, language and date; with a priority the id is url#priority."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(_MAP).load(path)
    when = F.coalesce(parse_time(F.col("news.publish_date")), parse_time(F.col("lastmod")), now)
    out = _stub(rows, href=F.trim("loc"), id=F.when(F.col("priority").isNotNull(), F.concat("loc", F.lit("#"), F.col("priority").cast("string"))), title=F.col("news.title"), language=F.coalesce("news.publication_language", F.lit(language)), outlet=F.coalesce("news.publication_name", F.lit(outlet)), text=F.lit(""), created_at=when, labels=F.array())
    return require(out, "href")


def read_json_list_feed(spark: SparkSession, path, services: dict[str, str], now: Column, language: str | None = None, outlet: str | None = None, lines: bool = False, max_age: Column | None = None, on_error: str = "drop_feed") -> DataFrame:
    """Stubs of JSON list feeds (a reply a file, or with ``lines`` a reply a line); services: URL templates by service name with {id} and {category}.

    Sponsored and undated records go. A record of an unknown service, of the future, updated before it was made, or last
    updated ``max_age`` (an interval; two days where none is given) ago or earlier is an error: its whole reply gives
    nothing, or with on_error drop_row the record alone. A different canonical URL comes first.
    """
    age = F.expr("interval 2 days") if max_age is None else max_age

    def sought(r: Column) -> Column:
        return ~F.coalesce(r["metadata"]["sponsored_content"], F.lit(False)) & (F.coalesce(r["published_at"], F.lit("")) != "")

    def sound(r: Column) -> Column:
        made = F.try_to_timestamp(r["published_at"])
        last = F.when(F.coalesce(r["updated_at"], F.lit("")) == "", made).otherwise(F.try_to_timestamp(r["updated_at"]))
        return F.coalesce(F.lower(r["service_name"]).isin(*[x.lower() for x in services]) & (made <= now) & (last >= made) & (last > now - age), F.lit(False))

    replies = spark.read.schema(_LIST).option("multiLine", not lines).json(path).select(F.filter("response", sought).alias("response"))
    if on_error == "drop_feed":
        replies = replies.where(F.forall("response", sound))
    rows = replies.select(F.explode("response").alias("r")).where(sound(F.col("r"))).select("r.*")
    template = F.try_element_at(F.create_map(*[F.lit(x) for k, v in services.items() for x in (k.lower(), v)]), F.lower("service_name"))
    own = F.replace(F.replace(template, F.lit("{id}"), F.col("article_id")), F.lit("{category}"), F.coalesce("category.category_name", F.lit("")))
    made = F.try_to_timestamp("published_at")
    out = _stub(rows, href=F.coalesce(F.nullif(F.col("metadata.canonical_url"), F.lit("")), own), id=F.col("article_id"), title=F.col("title"), language=F.lit(language), outlet=F.lit(outlet), text=F.col("lead"), created_at=made, updated_at=F.coalesce(F.try_to_timestamp("updated_at"), made), labels=F.array())
    return require(out, "href", "id")


def read_json_nested_feed(spark: SparkSession, path, publications: dict[str, tuple[str, str]], now: Column, language: str | None = None, lines: bool = False) -> DataFrame:
    """Stubs of nested JSON feeds (a reply a file, or with ``lines`` a reply a line); publications: (outlet, URL template with {section} and {id}) by name.

    Replies that aren't ok, other containers, and stories without id, headline, known publication or a sound time go.
    """
    docs = spark.read.schema(_NESTED).option("multiLine", not lines).json(path).where("ok")
    child = docs.select(F.explode("data.groups.children").alias("c")).select(F.explode("c").alias("c")).where("c.type = 'story_list_container'")
    s = child.select(F.explode("c.data.stories").alias("s")).select("s.data.story.data.*")
    names = F.create_map(*[F.lit(x) for k, v in publications.items() for x in (k, v[0])])
    urls = F.create_map(*[F.lit(x) for k, v in publications.items() for x in (k, v[1])])
    href = F.replace(F.replace(F.try_element_at(urls, F.col("publication")), F.lit("{section}"), F.coalesce("section", F.lit(""))), F.lit("{id}"), F.col("id"))
    made = F.try_to_timestamp("published_at")
    authors = F.filter(F.col("authors.full_name"), lambda a: F.coalesce(a, F.lit("")) != "")
    labels = F.when(F.col("advertiser").isNotNull(), F.array(F.lit("sponsored"))).otherwise(F.array().cast(_NONE))
    out = _stub(s, href=href, id=F.col("id"), title=F.col("headline"), authors=authors, language=F.lit(language), outlet=F.try_element_at(names, F.col("publication")), created_at=made, updated_at=F.coalesce(F.try_to_timestamp("updated_at"), made), labels=labels)
    return require(out.where("updated_at >= created_at").where(F.col("created_at") <= now), "href", "id", "title")


def read_sources(spark: SparkSession, path) -> DataFrame:
    """Source settings (JSON): a single url becomes a list, defaults are filled in; ``pos`` is the line's order."""
    schema = "name string, url string, type string, enabled boolean, language string, min_content_length int, max_num_articles int, max_age_days int, pos long"
    rows = spark.read.schema(schema).json(path)
    urls = F.coalesce(F.from_json("url", "array<string>"), F.array("url"))
    filled = {"type": "rss", "enabled": True, "min_content_length": 300, "max_num_articles": 100, "max_age_days": 21}
    return rows.withColumn("url", F.when(F.startswith("url", F.lit("[")), urls).otherwise(F.array("url"))).fillna(filled)


def read_revisions(spark: SparkSession, path) -> DataFrame:
    """Revisions of wiki query replies: pages of the main namespace, each revision once."""
    page = "struct<pageid: long, ns: int, title: string, revisions: array<struct<revid: long, parentid: long, user: string, timestamp: string, comment: string, tags: array<string>>>>"
    rows = spark.read.schema(f"query struct<pages: map<string, {page}>>").option("multiLine", False).json(path)
    pages = rows.select(F.explode(F.map_values("query.pages")).alias("p")).where("p.ns = 0")
    r = pages.select("p.pageid", "p.title", F.explode("p.revisions").alias("r"))
    return r.select("pageid", "title", "r.revid", "r.parentid", "r.user", F.try_to_timestamp("r.timestamp").alias("ts"), "r.comment", "r.tags").distinct()


@dataclass
class SourceRegistry:
    """Readers by name and alias; of several under one name the heaviest is used."""

    entries: dict[str, list[tuple[int, Callable]]] = field(default_factory=dict)

    def register(self, *names: str, weight: int = 50):
        """A decorator; registering a reader again changes its weight."""

        def add(fn: Callable) -> Callable:
            for n in names:
                self.entries[n] = sorted([e for e in self.entries.get(n, []) if e[1] is not fn] + [(weight, fn)], key=lambda e: -e[0])
            return fn

        return add

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"no reader is called {name}; there are {', '.join(self.list())}")
        return self.entries[name][0][1]

    def all(self, name: str) -> list[Callable]:
        return [fn for _, fn in self.entries.get(name, [])]

    def list(self) -> list[str]:
        return sorted(self.entries)

    def clear(self) -> None:
        self.entries.clear()

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def __len__(self) -> int:
        return len(self.entries)

    def __call__(self, name: str, *args, **kw) -> DataFrame:
        return self.get(name)(*args, **kw)


readers = SourceRegistry()
readers.register("rss", "atom")(read_feed_xml)
readers.register("sitemap")(read_sitemap_xml)


@readers.register("links")
def read_page_links(spark: SparkSession, path, now: Column, language: str | None = None) -> DataFrame:
    """Stubs of the links on saved pages (Parquet: page_id, url, html), as of ``now``."""
    links = page_links(spark.read.parquet(path))
    return _stub(links, href=F.col("href"), language=F.lit(language), created_at=now, labels=F.array())


def json_list_reader(services: dict[str, str], **options) -> Callable:
    """A reader to register: read_json_list_feed for a service's URL templates."""
    return lambda spark, path, now, language=None: read_json_list_feed(spark, path, services, now, language, **options)


def json_nested_reader(publications: dict[str, tuple[str, str]], **options) -> Callable:
    """A reader to register: read_json_nested_feed for known publications."""
    return lambda spark, path, now, language=None: read_json_nested_feed(spark, path, publications, now, language, **options)


#: Partitions of one URL's stubs, at most, and the bits of ``pos`` below the URL's number that they and their rows take.
URL_PARTS, URL_BITS = 8192, 46


def discover(spark: SparkSession, sources: Sequence[dict], now: Column, registry: SourceRegistry = readers, failed: list | None = None) -> DataFrame:
    """The stubs of all URLs (one or a list) of enabled sources ({name, url, type, language}), in order, with ``pos`` unique and rising.

    A URL that can't be read gives nothing; with ``failed`` a list, (source, url, message) is added to it. Within a source
    a URL or id that comes again goes (see ``dedup_first_wins``). A stub without an outlet gets the source's name. The list
    of sources is a configuration, so it is walked on the driver; each URL's stubs are written as they are read.
    """
    out, number = None, 0
    for s in (x for x in sources if x.get("enabled", True)):
        reader, own = registry.get(s.get("type", "rss")), None
        for url in [s["url"]] if isinstance(s["url"], str) else s["url"]:
            try:
                rows = reader(spark, url, now, s.get("language")).coalesce(URL_PARTS)
                rows = rows.withColumn("outlet", F.coalesce(F.nullif(F.col("outlet"), F.lit("")), F.lit(s["name"])))
                rows = written(rows.withColumn("pos", F.lit(number << URL_BITS) + F.monotonically_increasing_id()))
            except (PySparkException, Py4JJavaError) as e:
                if failed is not None:
                    failed.append((s["name"], url, str(e)[:300]))
                continue
            finally:
                number += 1
            own = rows if own is None else own.unionByName(rows)
        if own is not None:
            own = dedup_first_wins(own, None)
            out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], EMPTY) if out is None else out
