"""Article stubs: filters, ranks and de-duplication.

A stub has ``pos`` (its place in the order of discovery, unique), ``outlet``, ``id``, ``created_at``, ``updated_at``
and either one ``href`` or an array ``urls``. Source settings are a small dimension: name, enabled, max_age_days,
max_num_articles, pos.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfold.functions.graph import connected_components
from newsfold.functions.runtime import parts, small, written


def recency(df: DataFrame) -> Column:
    """The update time, else the creation time."""
    found = [F.col(c) for c in ("updated_at", "created_at") if c in df.columns]
    return F.coalesce(*found)


def source_settings(sources: DataFrame) -> DataFrame:
    """One row per enabled source; of equal names the last counts."""
    last = sources.where("name is not null").groupBy("name").agg(F.max_by(F.struct(*[c for c in sources.columns if c != "name"]), "pos").alias("s"))
    return last.select("name", "s.*").where("enabled")


def attribute_sources(stubs: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """stubs with the settings of their outlet's enabled source."""
    dim = source_settings(sources).select(F.col("name").alias("outlet"), "max_age_days", "max_num_articles")
    return stubs.join(small(dim), "outlet", how)


def filter_max_age(stubs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Stubs not older than their source allows at ``now``; undated ones count as new, no limit keeps all."""
    rows = attribute_sources(stubs, sources)
    cut = now - F.make_dt_interval(F.col("max_age_days"))
    return rows.where(F.col("max_age_days").isNull() | (F.coalesce(recency(stubs), now) >= cut)).select(*stubs.columns)


def newest_per_outlet(rows: DataFrame, most: int | None, order: Sequence[Column], at: str) -> DataFrame:
    """rows (with outlet and max_num_articles) that are among the first max_num_articles of their outlet; no limit keeps all.

    most: the largest limit, a literal, so that Spark ranks no further than that. Ranks are taken in buckets of an outlet
    first and then among what is left, so no task sorts a whole outlet; rows without a limit are in no group with others
    (``at`` is a unique column) and pass.
    """
    if most is None:
        return rows
    alone = F.when(F.col("max_num_articles").isNull(), F.col(at))
    for bucket in (F.pmod(F.xxhash64(at), F.lit(parts(rows.sparkSession, 1))), F.lit(0)):
        w = Window.partitionBy("outlet", F.coalesce(alone, F.lit(-1)), bucket).orderBy(*order)
        rows = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most)
    return rows.where(alone.isNotNull() | (F.col("__rn") <= F.col("max_num_articles"))).drop("__rn")


def largest_limit(sources: DataFrame) -> int | None:
    """The largest max_num_articles of enabled sources; null if none has a limit."""
    return source_settings(sources).agg(F.max("max_num_articles")).first()[0]


def latest_per_source(stubs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """The newest max_num_articles stubs of each enabled source, after the age limit; ties in order of discovery."""
    rows = attribute_sources(filter_max_age(stubs, sources, now), sources)
    order = [F.desc_nulls_last(recency(stubs)), F.asc("pos")]
    return newest_per_outlet(rows, largest_limit(sources), order, "pos").select(*stubs.columns)


def newest_first(stubs: DataFrame) -> DataFrame:
    return stubs.orderBy(F.desc_nulls_last(recency(stubs)), F.asc("pos"))


def sample_latest(stubs: DataFrame, n: int = 5) -> DataFrame:
    """The n latest created; undated ones are oldest."""
    return stubs.orderBy(F.desc_nulls_last("created_at"), F.asc("pos")).limit(n)


def valid_times(stubs: DataFrame, now: Column, on_error: str = "drop_row", feed: str = "feed", max_age: Column | None = None) -> DataFrame:
    """Stubs created by ``now`` and not updated before that; with drop_feed one bad row drops its whole feed.

    With max_age (an interval; list feeds have two days) the last update must be younger than that.
    """
    good = (F.col("created_at") <= now) & (F.coalesce("updated_at", "created_at") >= F.col("created_at"))
    if max_age is not None:
        good &= F.coalesce("updated_at", "created_at") > now - max_age
    if on_error == "drop_row":
        return stubs.where(good)
    bad = stubs.where(~F.coalesce(good, F.lit(False))).select(feed).distinct()
    return stubs.join(bad, feed, "left_anti")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where these columns are neither null nor empty."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def not_sponsored(stubs: DataFrame, flag: str = "sponsored") -> DataFrame:
    return stubs.where(~F.coalesce(F.col(flag), F.lit(False)))


def filter_min_length(articles: DataFrame, least: int = 300) -> DataFrame:
    """Articles of at least so many characters; null text has none."""
    return articles.where(F.length(F.coalesce("text", F.lit(""))) >= least)


def spread_by_host(stubs: DataFrame, n: int) -> DataFrame:
    """stubs dealt evenly to n partitions, so that no task has one host alone."""
    return stubs.repartition(n, F.xxhash64("href"))


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """urls (href) with ``allowed``: the first rule (host, agent, prefix, allow, pos) of the host that fits; none: allowed.

    Of rules with one prefix only the first counts. A path is expanded into its prefixes of the lengths that the host's rules have, and these
    meet the rules by equality, so a path never meets the rules that don't fit it. Rules without a prefix fit nothing.
    """
    u = urls.withColumn("__h", F.lower(F.parse_url("href", F.lit("HOST")))).withColumn("__p", F.coalesce(F.parse_url("href", F.lit("PATH")), F.lit("")))
    fit = rules.where(((F.col("agent") == "*") | (F.lower("agent") == agent.lower())) & F.col("prefix").isNotNull())
    r = fit.groupBy(F.col("host").alias("__h"), F.col("prefix").alias("__start")).agg(F.min_by("allow", "pos").alias("allow"), F.min("pos").alias("__rule"))
    lengths = r.groupBy("__h").agg(F.sort_array(F.collect_set(F.length("__start"))).alias("__lengths"))  # as many as a prefix has characters at most
    starts = F.transform(F.filter("__lengths", lambda n: n <= F.length("__p")), lambda n: F.substring(F.col("__p"), F.lit(1), n))
    paths = u.select("__h", "__p").distinct().join(lengths, "__h").select("__h", "__p", F.explode(starts).alias("__start"))
    first = paths.join(r, ["__h", "__start"]).groupBy("__h", "__p").agg(F.min_by("allow", "__rule").alias("allow"))
    return u.join(first, ["__h", "__p"], "left").select(*urls.columns, F.coalesce("allow", F.lit(True)).alias("allowed"))


def route_urls(urls: DataFrame, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """urls (href) with ``route``: of the rules (name, pattern, weight) that match, the heaviest, the first of equals.

    The rules are a short list, so they are one CASE expression; what matches none has a null route.
    """
    route = F.lit(None).cast("string")
    for name, pattern, _ in reversed(sorted(rules, key=lambda r: -r[2])):
        route = F.when(F.col("href").rlike(pattern), F.lit(name)).otherwise(route)
    return urls.withColumn("route", route)


#: (stub, URL) rows of a component that one task walks through at most.
WALK_ROWS = 50_000
#: Share of the pairs which a round must not leave; otherwise they are split into components.
SLOW = 0.8


def _round(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over undecided pairs (pos, href): the stubs that go (pos), and the pairs that stay undecided; both of written tables.

    A stub that is first for all of its URLs is taken; those that share a URL with it go. Minima are combined before the shuffle, and what holds
    for all URLs of a stub is found over its few pairs.
    """
    own = Window.partitionBy("pos")
    first = pairs.groupBy("href").agg(F.min("pos").alias("first"))
    judged = written(pairs.join(first, "href").select("pos", "href", F.min(F.col("pos") == F.col("first")).over(own).alias("taken")))
    held = judged.where("taken").select("href", F.lit(True).alias("held"))  # a URL has one first stub
    rest = judged.where("not taken").join(held, "href", "left").select("pos", "href", F.max(F.coalesce("held", F.lit(False))).over(own).alias("gone"))
    rest = written(rest)
    return rest.where("gone").select("pos"), rest.where("not gone").select("pos", "href")


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The stubs that go, in order of ``pos``."""
    held: set[str] = set()
    gone = []
    for pos, own in pdf.groupby("pos", sort=True)["href"]:
        if held.isdisjoint(own):
            held.update(own)
        else:
            gone.append(pos)
    return pd.DataFrame({"pos": pd.Series(gone, dtype="int64")})


def _walked(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The stubs that go (pos) of all components of stubs with common URLs of at most ``most`` pairs, and the pairs of the others; both written.

    A component is walked through in order of ``pos`` in one group, so a chain of any length is one pass.
    """
    first = pairs.groupBy("href").agg(F.min("pos").alias("first"))
    roots = connected_components(pairs.join(first, "href").select(F.col("pos").alias("a"), F.col("first").alias("b")))
    rows = written(pairs.join(roots.withColumnRenamed("node", "pos"), "pos", "left").withColumn("root", F.coalesce("root", "pos")))
    large = written(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root"))
    gone = rows.join(large, "root", "left_anti").groupBy("root").applyInPandas(_walk, "pos long")
    return written(gone), written(rows.join(large, "root", "left_semi").select("pos", "href"))


def dedup_first_wins(stubs: DataFrame, urls: str | None = "urls", walk_rows: int = WALK_ROWS) -> DataFrame:
    """stubs without later holders of a URL or an id, in order of ``pos``.

    A stub goes if one of its URLs belongs to an earlier stub that was taken over; of the rest, which hold their URLs even
    so, all but the first of each id go. Null ids and stubs without URLs never collide. urls: an array column of hrefs;
    None: the single column ``href``.

    Rounds decide what has one URL each and, where URLs are shared at random, a good part of the rest each. As soon as at most ``walk_rows`` pairs are
    left, these are walked through in one group. Where a round decides little, as in chains, the pairs are split into components of stubs with
    common URLs: those of at most ``walk_rows`` pairs are walked through in one grouped pass; larger ones go on in rounds, each of which decides at
    least the first stub of every component, and are split again when half of them are left.
    """
    href = F.explode(F.array_distinct(F.col(urls))) if urls else F.col("href")
    pairs = written(stubs.select(F.col("pos").cast("long").alias("pos"), href.alias("href")).where("href is not null"))
    lost = []
    n, before, split = pairs.count(), None, None
    while n:
        if n <= walk_rows:
            gone, left = written(pairs.withColumn("root", F.lit(0)).groupBy("root").applyInPandas(_walk, "pos long")), None
        elif before and n > SLOW * before and (split is None or 2 * n <= split):
            (gone, left), split = _walked(pairs, walk_rows), n
        else:
            gone, left = _round(pairs)
        lost.append(gone)
        pairs, n, before = left, left.count() if left is not None else 0, n
    kept = stubs.join(reduce(DataFrame.unionByName, lost), "pos", "left_anti") if lost else stubs
    firsts = kept.where("id is not null").groupBy("id").agg(F.min("pos").alias("pos"))
    return kept.join(firsts.select("pos"), "pos", "left_semi").unionByName(kept.where("id is null"))
