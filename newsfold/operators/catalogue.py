"""The stored catalogue: match, upsert, prune, report.

An entry has ``idx`` (its place, unique), ``updated``, ``urls`` (array of sign and labels), title, clickbaitiness,
labels, outlet. Articles have a key, ``created_at``, ``updated_at`` and ``urls`` (array of href, labels, signature).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfold.functions.runtime import written
from newsfold.operators.stubs import attribute_sources, largest_limit, newest_per_outlet

#: The five answers of the scale, from the mildest.
CLICKBAIT = ("Not Clickbait at all", "Slightly Clickbaity", "Moderately Clickbaity", "Very Clickbaity", "Extremely Clickbaity")
LABELS = "array<string>"


def clickbait_level(name: Column) -> Column:
    """1 to 5; null for another text."""
    at = F.array_position(F.array(*[F.lit(x) for x in CLICKBAIT]), name)
    return F.when(at > 0, at.cast("int"))


def clickbait_distribution(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("outlet", clickbait_level(F.col("clickbaitiness")).alias("level")).groupBy("outlet", "level").agg(F.count(F.lit(1)).alias("n"))


def signs(catalogue: DataFrame) -> DataFrame:
    """(sign, idx): the first entry of every signature."""
    each = catalogue.select("idx", F.explode("urls.sign").alias("sign")).where("sign is not null and sign <> ''")
    return each.groupBy("sign").agg(F.min("idx").alias("idx"))


def match_catalogue(articles: DataFrame, catalogue: DataFrame, key: str = "pos") -> DataFrame:
    """(key, idx): the entry of the first of an article's URLs that has one; null without."""
    probes = articles.select(key, F.posexplode_outer("urls.signature").alias("__at", "sign"))
    return probes.join(signs(catalogue), "sign", "left").groupBy(key).agg(F.min_by("idx", F.when(F.col("idx").isNotNull(), F.col("__at"))).alias("idx"))


def needs_update(articles: DataFrame, catalogue: DataFrame, key: str = "pos") -> DataFrame:
    """Articles that are undated, unknown, or newer than their entry."""
    found = match_catalogue(articles, catalogue, key).join(catalogue.select("idx", F.col("updated").alias("__stored")), "idx", "left").select(key, "__stored")
    when = F.greatest("updated_at", "created_at")
    return articles.join(found, key, "left").where(when.isNull() | F.col("__stored").isNull() | (when > F.col("__stored"))).select(*articles.columns)


def merge_articles(stubs: DataFrame, full: DataFrame, on: str = "href") -> DataFrame:
    """Stubs with what their extracted page adds; stubs without a page go.

    Creation is the earlier, update the later time; the page's title, outlet and language win where they aren't empty;
    the strictly longer text wins; URLs with a new signature are appended; labels stay the stub's.
    """
    s, f = stubs.alias("s"), full.alias("f")

    def better(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"f.{c}"), F.lit("")), F.col(f"s.{c}")).alias(c)

    longer = F.length(F.coalesce("f.text", F.lit(""))) > F.length(F.coalesce("s.text", F.lit("")))
    added = F.filter("f.urls", lambda u: ~F.array_contains(F.transform("s.urls", lambda v: v["signature"]), u["signature"]))
    cols = {
        "created_at": F.least("s.created_at", "f.created_at"),
        "updated_at": F.greatest("s.updated_at", "f.updated_at"),
        "text": F.when(longer, F.col("f.text")).otherwise(F.col("s.text")),
        "urls": F.concat("s.urls", added),
    }
    out = [cols[c].alias(c) if c in cols else better(c) if c in ("title", "outlet", "language") else F.col(f"s.{c}") for c in stubs.columns]
    return s.join(f, on).select(*out)


def unique_urls(catalogue: DataFrame) -> DataFrame:
    """Entries whose URLs have each signature once: the URL with the most labels, the first of equals; most labels first."""
    u = catalogue.select("idx", F.posexplode("urls").alias("pos", "url"))
    best = u.groupBy("idx", "url.sign").agg(F.min(F.struct((-F.size("url.labels")).alias("n"), "pos", "url")).alias("b"))
    urls = best.groupBy("idx").agg(F.array_sort(F.collect_list("b")).alias("b")).select("idx", F.col("b.url").alias("urls"))
    rest = [F.coalesce("urls", F.array().cast(catalogue.schema["urls"].dataType)).alias(c) if c == "urls" else F.col(c) for c in catalogue.columns]
    return catalogue.drop("urls").join(urls, "idx", "left").select(*rest)


def to_catalogue_rows(articles: DataFrame) -> DataFrame:
    """Articles as catalogue rows: the later time, and the URLs that have a signature."""
    urls = F.transform(F.filter("urls", lambda u: u["signature"] != ""), lambda u: F.struct(u["signature"].alias("sign"), u["labels"].alias("labels")))
    return articles.select("pos", F.greatest("updated_at", "created_at").alias("updated"), urls.alias("urls"), "title", "clickbaitiness", "labels", "outlet")


def upsert_catalogue(catalogue: DataFrame, batch: DataFrame, keep_old_urls: bool = False, top: int | None = None) -> DataFrame:
    """The catalogue after a batch of rows (pos, updated, urls, title, clickbaitiness, labels, outlet).

    A row goes to the entry that holds the first of its signatures that is known; rows with no known signature that
    share their first signature are one new entry, appended in order of arrival. Of several rows for an entry the last
    one's non-empty values count; times take the maximum, labels the union, URLs are replaced (or added to the old ones).
    top: the largest place so far, where catalogue is only the part that the batch may meet.
    """
    as_articles = batch.withColumn("urls", F.transform("urls", lambda u: F.struct(u["sign"].alias("signature"), u["labels"].alias("labels"))))
    found = match_catalogue(as_articles, catalogue)
    own = F.coalesce(F.get(F.filter("urls.sign", lambda s: s != ""), F.lit(0)), F.concat(F.lit("#"), F.col("pos").cast("string")))
    rows = batch.join(found, "pos").withColumn("__new", F.when(F.col("idx").isNull(), own))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("pos"))).alias(f"__{c}")

    folded = rows.groupBy("idx", "__new").agg(
        F.max("updated").alias("__updated"), F.min("pos").alias("__pos"), last("title"), last("clickbaitiness"), last("outlet"),
        F.max_by("urls", "pos").alias("__urls"), F.array_distinct(F.flatten(F.collect_set("labels"))).alias("__labels"),
    )
    both = catalogue.join(folded.where("idx is not null").drop("__new", "__pos"), "idx", "left")

    def newer(c: str) -> Column:
        return F.coalesce(f"__{c}", c).alias(c)

    if keep_old_urls:
        added = F.filter(F.coalesce("urls", F.array().cast(catalogue.schema["urls"].dataType)), lambda u: ~F.array_contains(F.transform("__urls", lambda v: v["sign"]), u["sign"]))
        urls = F.when(F.col("__urls").isNotNull(), F.concat("__urls", added)).otherwise(F.col("urls")).alias("urls")
    else:
        urls = newer("urls")
    none = F.array().cast(LABELS)
    labels = F.array_union(F.coalesce("labels", none), F.coalesce("__labels", none)).alias("labels")
    kept = both.select("idx", F.greatest("updated", "__updated").alias("updated"), urls, newer("title"), newer("clickbaitiness"), labels, newer("outlet"))
    if top is None:
        fresh = folded.where("idx is null").crossJoin(F.broadcast(catalogue.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("__base"))))  # one row
    else:
        fresh = folded.where("idx is null").withColumn("__base", F.lit(top).cast("long"))
    fresh = fresh.select((F.col("__base") + 1 + F.col("__pos")).alias("idx"), *[F.col(f"__{c}").alias(c) for c in ("updated", "urls", "title", "clickbaitiness", "labels", "outlet")])
    return kept.unionByName(fresh)


def prune_catalogue(catalogue: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Entries of enabled sources, not older than allowed, the newest max_num_articles of each; the order stays idx."""
    rows = attribute_sources(catalogue, sources)
    rows = rows.where(F.col("max_age_days").isNull() | (F.col("updated") >= now - F.make_dt_interval(F.col("max_age_days"))))
    return newest_per_outlet(rows, largest_limit(sources), [F.desc("updated"), F.asc("idx")], "idx").select(*catalogue.columns)


def removed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select("idx"), "idx", "left_anti")


def high_water_mark(catalogue: DataFrame, old: Column | None = None) -> DataFrame:
    """(updated): the latest entry's time, or ``old`` if that is later."""
    return catalogue.agg(F.max("updated").alias("updated")).select(F.greatest("updated", *([old] if old is not None else [])).alias("updated"))


def change_report(upserted: DataFrame, removed: DataFrame) -> DataFrame:
    """(action, sign, title): seven characters of the first signature and at most 68 of the title, for each change."""

    def lines(df: DataFrame, action: str) -> DataFrame:
        title = F.when(F.length("title") > 68, F.concat(F.substring("title", 1, 65), F.lit("..."))).otherwise(F.col("title"))
        return df.select(F.lit(action).alias("action"), F.substring(F.get("urls.sign", F.lit(0)), 1, 7).alias("sign"), title.alias("title"))

    return lines(upserted, "upserted").unionByName(lines(removed, "removed"))


def read_catalogue(spark: SparkSession, path: str, now: Column | None = None, lines: bool = False) -> DataFrame:
    """The entries of a catalogue document (one a file, or with ``lines`` one a line: status, schema_version, updated, entries[]) in their order, with ``as_of``.

    A path without a document is an empty catalogue.
    """
    url = "struct<sign: string, labels: array<string>>"
    entry = f"struct<updated: timestamp_ntz, urls: array<{url}>, title: string, clickbaitiness: string, labels: array<string>, outlet: string>"
    schema = f"status string, schema_version string, updated timestamp_ntz, entries array<{entry}>"
    try:
        doc = spark.read.schema(schema).json(path, multiLine=not lines)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        doc = spark.createDataFrame([], schema)
    return doc.select(F.coalesce("updated", now if now is not None else F.localtimestamp()).alias("as_of"), F.posexplode("entries").alias("idx", "e")).select("as_of", F.col("idx").cast("long").alias("idx"), "e.*")


def write_catalogue(catalogue: DataFrame, path: str) -> DataFrame:
    """Write a new snapshot as JSON lines and return it read back under the same schema; raises if rows are missing."""
    catalogue = written(catalogue)
    exact = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    catalogue.write.options(**exact).json(path)
    back = catalogue.sparkSession.read.schema(catalogue.schema).options(**exact).json(path)
    if back.count() != catalogue.count():
        raise ValueError(f"{path} doesn't hold what was written")
    return back
