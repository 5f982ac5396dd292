"""Queries of the stub and catalogue operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfold.functions import urls as U
from newsfold.functions.runtime import shared_dir, written
from newsfold.operators import catalogue as C
from newsfold.operators import stubs as S
from newsfold.plans import views as V
from newsfold.plans.views import BATCH, CATALOGUE, INCOMING, NOW, SOURCES, STUBS, ctes

ENABLED = "enabled as (select name as outlet, max_age_days, max_num_articles from sources where enabled)"
FIELDS = "pos, outlet, href, id, updated_at"
COLS = ["pos", "outlet", "href", "id", "updated_at"]


def filter_max_age(spark, d):
    return S.filter_max_age(V.stubs(spark, d), V.sources(spark, d), V.now()).select(COLS)


AGED = f"aged as (select stubs.*, max_num_articles from stubs join enabled using (outlet) where max_age_days is null or updated_at >= timestamp '{NOW}' - max_age_days * interval 1 day)"


def latest_per_source(spark, d):
    s = V.stubs(spark, d).where(U.has_handled_url(F.col("urls")))
    return S.latest_per_source(S.not_sponsored(S.require(s, "href", "id")), V.sources(spark, d), V.now()).select(COLS)


LATEST = f"""
{ctes(STUBS, SOURCES, ENABLED, AGED.replace("where max_age", "where not sponsored and (max_age").replace("interval 1 day)", "interval 1 day))"))},
r as (select *, row_number() over (partition by outlet order by updated_at desc, pos) as rn from aged)
select {FIELDS} from r where max_num_articles is null or rn <= max_num_articles"""


def dedup_first_wins(spark, d):
    return S.dedup_first_wins(V.stubs(spark, d), None).select(COLS)


DEDUP = f"""
{ctes(STUBS)},
u as (select *, row_number() over (partition by href order by pos) as rn from stubs),
i as (select *, row_number() over (partition by id order by pos) as ri from u where rn = 1)
select {FIELDS} from i where ri = 1"""


def dedup_urls(spark, d):
    """Stubs with two URLs each: their own and one shared by a user's neighbours in time."""
    s = V.stubs(spark, d)
    two = F.array("href", F.concat(F.lit("https://short.example.org/"), F.floor(F.col("pos") / 3).cast("string")))
    return S.dedup_first_wins(s.withColumn("urls", two).withColumn("id", F.lit(None).cast("string"))).select("pos", "href")


#: The walk itself, a stub a step: held URLs are bits by their number.
DEDUP_URLS = f"""
with recursive {ctes(STUBS).removeprefix("with")},
n as (select pos, href, (row_number() over (order by pos))::int as i, dense_rank() over (order by href) - 1 as u, floor(pos / 3)::bigint as v0 from stubs),
m as (select pos, href, i, u::int as u, ((select max(u) + 1 from n) + dense_rank() over (order by v0) - 1)::int as v from n),
w(i, held, pos, kept) as (
  select 0, repeat('0', (select max(v) + 1 from m)::int)::bit, null::bigint, false
  union all select m.i, case when get_bit(held, m.u) = 0 and get_bit(held, m.v) = 0 then set_bit(set_bit(held, m.u, 1), m.v, 1) else held end, m.pos, get_bit(held, m.u) = 0 and get_bit(held, m.v) = 0
  from w join m on m.i = w.i + 1)
select m.pos, m.href from w join m using (pos) where kept"""


def match_catalogue(spark, d):
    return C.match_catalogue(V.incoming(spark, d), V.catalogue(spark, d))


MATCH = f"{ctes(STUBS, CATALOGUE, INCOMING)} select i.pos, c.idx from incoming i left join catalogue c on c.sign = i.signature"


def needs_update(spark, d):
    """The flagship: handled stubs, first of their URL and id, young enough, newest per source, that the catalogue needs.

    Feeds list what is new first, so the places run against the events' numbers.
    """
    found = V.stubs(spark, d).where(U.has_handled_url(F.col("urls"))).withColumn("pos", -F.col("pos"))
    s = S.dedup_first_wins(found, None)
    return C.needs_update(S.latest_per_source(s, V.sources(spark, d), V.now()), V.catalogue(spark, d)).select((-F.col("pos")).alias("pos"), *COLS[1:])


NEEDS = f"""
{ctes(STUBS, SOURCES, CATALOGUE, ENABLED)},
u as (select *, row_number() over (partition by href order by pos desc) as rn from stubs),
i as (select *, row_number() over (partition by id order by pos desc) as ri from u where rn = 1),
aged as (select i.* exclude (rn, ri), max_num_articles from i join enabled using (outlet) where ri = 1 and (max_age_days is null or updated_at >= timestamp '{NOW}' - max_age_days * interval 1 day)),
r as (select *, row_number() over (partition by outlet order by updated_at desc, pos desc) as rk from aged),
l as (select * from r where max_num_articles is null or rk <= max_num_articles)
select l.pos, l.outlet, l.href, l.id, l.updated_at from l left join catalogue c on c.sign = l.signature where c.idx is null or l.updated_at > c.updated"""


def merge_articles(spark, d):
    """Stub = the document without its lines after the first; page = the whole document, dated otherwise."""
    docs = V.articles(spark, d)
    url = F.concat(F.lit("https://"), "outlet", F.lit(".example.org/"), F.col("doc_id").cast("string"))
    base = docs.select(url.alias("href"), "doc_id", "outlet", "language", "text")
    day = F.lit("2024-01-01").cast("timestamp_ntz")

    def urls(*hrefs):
        return F.array(*[F.struct(h.alias("href"), F.array(F.lit("canonical")).alias("labels"), F.sha2(h, 256).alias("signature")) for h in hrefs])

    def dated(n):
        return day + F.make_dt_interval((F.col("doc_id") % n).cast("int"))

    stub = base.select("href", "doc_id", F.lit("").alias("title"), "outlet", F.lit(None).cast("string").alias("language"), F.substring_index("text", "\n", 1).alias("text"), dated(7).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), urls(F.col("href")).alias("urls"))
    full = base.where("doc_id % 5 <> 0").select("href", F.substring("text", 1, 20).alias("title"), F.lit("").alias("outlet"), "language", "text", dated(5).alias("created_at"), dated(11).alias("updated_at"), urls(F.col("href"), F.concat("href", F.lit("/full"))).alias("urls"))
    out = C.merge_articles(stub, full)
    return out.select("doc_id", "title", "outlet", "language", F.length("text").alias("n_chars"), "created_at", "updated_at", F.array_join("urls.href", " ").alias("hrefs"))


MERGE = """
select doc_id, left(text, 20) as title, source as outlet, lang as language, length(text)::int as n_chars,
  timestamp '2024-01-01' + least(doc_id % 7, doc_id % 5) * interval 1 day as created_at, timestamp '2024-01-01' + (doc_id % 11) * interval 1 day as updated_at,
  'https://' || source || '.example.org/' || doc_id || ' https://' || source || '.example.org/' || doc_id || '/full' as hrefs
from documents where doc_id % 5 <> 0"""


def flat(c):
    return c.select("idx", "updated", F.array_join(F.array_sort("urls.sign"), " ").alias("signs"), "title", "clickbaitiness", F.array_join(F.array_sort("labels"), " ").alias("labels"), "outlet")


def upsert_catalogue(spark, d):
    return flat(C.upsert_catalogue(V.catalogue(spark, d), V.batch(spark, d)))


UPSERTED = f"""
f as (select sign, max(updated) as updated, arg_max(title, pos) filter (where title <> '') as title, min(pos) as pos, arg_max(outlet, pos) as outlet,
  list(distinct labels) filter (where labels <> '') as labels from batch group by sign),
top as (select coalesce(max(idx), -1) as base from catalogue),
upserted as (
  select c.idx, greatest(c.updated, f.updated) as updated, c.sign as signs, coalesce(f.title, c.title) as title, case when f.sign is null then c.clickbaitiness else '{C.CLICKBAIT[0]}' end as clickbaitiness,
    array_to_string(list_sort(list_distinct(list_concat(case when c.labels = '' then []::varchar[] else [c.labels] end, coalesce(f.labels, []::varchar[])))), ' ') as labels, c.outlet
  from catalogue c left join f using (sign)
  union all
  select base + 1 + f.pos, f.updated, f.sign, f.title, '{C.CLICKBAIT[0]}', coalesce(array_to_string(list_sort(f.labels), ' '), ''), f.outlet from f, top where f.sign not in (select sign from catalogue))"""
UPSERT = f"{ctes(STUBS, CATALOGUE, INCOMING, BATCH, UPSERTED)} select * from upserted"


def prune_catalogue(spark, d):
    return flat(C.prune_catalogue(C.upsert_catalogue(V.catalogue(spark, d), V.batch(spark, d)), V.sources(spark, d), V.now()))


PRUNED = f"""
aged as (select u.*, max_num_articles from upserted u join enabled using (outlet) where max_age_days is null or updated >= timestamp '{NOW}' - max_age_days * interval 1 day),
ranked as (select *, row_number() over (partition by outlet order by updated desc, idx) as rn from aged),
pruned as (select idx, updated, signs, title, clickbaitiness, labels, outlet from ranked where max_num_articles is null or rn <= max_num_articles)"""
_ALL = ctes(STUBS, SOURCES, CATALOGUE, INCOMING, BATCH, UPSERTED, ENABLED, PRUNED)


def removed_entries(spark, d):
    full = written(C.upsert_catalogue(V.catalogue(spark, d), V.batch(spark, d)))
    return C.removed_entries(full, C.prune_catalogue(full, V.sources(spark, d), V.now())).select("idx", "outlet", "title")


REMOVED = f"{_ALL} select idx, outlet, title from upserted where idx not in (select idx from pruned)"


def change_report(spark, d):
    full = written(C.upsert_catalogue(V.catalogue(spark, d), V.batch(spark, d)))
    gone = C.removed_entries(full, C.prune_catalogue(full, V.sources(spark, d), V.now()))
    rows = C.change_report(full.where(F.col("updated") >= F.lit(V.SPLIT).cast("timestamp_ntz")), gone)
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("sign").alias("first_sign"), F.max("title").alias("last_title"))


REPORT = f"""{_ALL}, r as (
  select 'upserted' as action, signs, title from upserted where updated >= timestamp '{V.SPLIT}' union all
  select 'removed', signs, title from upserted where idx not in (select idx from pruned))
select action, count(*) as n, min(left(signs, 7)) as first_sign, max(title) as last_title from r group by action"""


def high_water_mark(spark, d):
    by = V.batch(spark, d).groupBy("outlet").agg(F.max("updated").alias("new"))
    old = V.catalogue(spark, d).groupBy("outlet").agg(F.max("updated").alias("old"))
    return old.join(by, "outlet", "left").select("outlet", F.greatest("old", "new").alias("updated"))


HIGH = f"{ctes(STUBS, CATALOGUE, INCOMING, BATCH)}, n as (select outlet, max(updated) as new from batch group by outlet) select outlet, greatest(max(updated), any_value(new)) as updated from catalogue left join n using (outlet) group by outlet"


def unique_urls(spark, d):
    """Entries of an outlet and hour, with a URL for each event; the events' types are the labels."""
    s = V.stubs(spark, d)
    labels = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("k") % 3)
    u = s.withColumn("idx", F.floor(F.col("pos") / 200)).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("id").alias("sign"), labels.alias("labels")).alias("url")))).alias("u"))
    out = C.unique_urls(u.select("idx", F.col("u.url").alias("urls")))
    return out.select("idx", F.size("urls").cast("long").alias("n"), F.array_join("urls.sign", " ").alias("signs"))


UNIQUE = f"""{ctes(STUBS)}, u as (select pos // 200 as idx, pos, id as sign, k % 3 as n from stubs),
b as (select *, row_number() over (partition by idx, sign order by n desc, pos) as rn from u)
select idx, count(*) as n, string_agg(sign, ' ' order by n desc, pos) as signs from b where rn = 1 group by idx"""


def to_catalogue_rows(spark, d):
    return V.batch(spark, d).select("pos", "updated", F.get("urls.sign", F.lit(0)).alias("sign"), "title", "outlet")


ROWS = f"{ctes(STUBS, INCOMING, BATCH)} select pos, updated, sign, title, outlet from batch"


def clickbait_level(spark, d):
    return C.clickbait_distribution(V.catalogue(spark, d))


CLICK = f"{ctes(STUBS, CATALOGUE)} select outlet, list_position([{', '.join(repr(x) for x in C.CLICKBAIT)}], clickbaitiness)::int as level, count(*) as n from catalogue group by all"


def catalogue_round_trip(spark, d):
    """The catalogue written as JSON and read back."""
    import uuid

    return flat(C.write_catalogue(V.catalogue(spark, d), f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"))


TRIP = f"{ctes(STUBS, CATALOGUE)} select idx, updated, sign as signs, title, clickbaitiness, labels, outlet from catalogue"


def sample_latest(spark, d):
    return S.sample_latest(V.stubs(spark, d)).select(COLS)


def newest_first(spark, d):
    return S.newest_first(V.stubs(spark, d)).select(COLS)


def spread_by_host(spark, d):
    """How stubs are spread: rows by outlet after dealing."""
    return S.spread_by_host(V.stubs(spark, d), 16).groupBy("outlet").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("n_urls"))


SPREAD = f"{ctes(STUBS)} select outlet, count(*) as n, count(distinct href) as n_urls from stubs group by outlet"


def valid_times(spark, d):
    s = V.stubs(spark, d).withColumn("updated_at", F.when(F.col("k") % 9 == 0, F.col("created_at") - F.expr("interval 1 day")).otherwise(F.col("updated_at")))
    s = s.withColumn("feed", F.concat("outlet", F.lit("/"), "id"))
    whole = S.valid_times(s, V.now(), "drop_feed").select("pos").withColumn("whole", F.lit(1))
    return S.valid_times(s, V.now()).join(whole, "pos", "left").select("pos", F.coalesce("whole", F.lit(0)).alias("feed_kept"))


TIMES = f"{ctes(STUBS)}, f as (select outlet, id, bool_and(k % 9 <> 0) as ok from stubs group by all) select pos, ok::int as feed_kept from stubs join f using (outlet, id) where k % 9 <> 0"


def filter_min_length(spark, d):
    return S.filter_min_length(V.articles(spark, d)).select("doc_id")


def source_attribution(spark, d):
    return S.attribute_sources(V.stubs(spark, d), V.sources(spark, d), "left").select("pos", "outlet", "max_age_days", "max_num_articles")


ATTR = f"{ctes(STUBS, SOURCES, ENABLED)} select pos, outlet, max_age_days, max_num_articles from stubs left join enabled using (outlet)"


QUERIES = {
    "filter_max_age": (filter_max_age, f"{ctes(STUBS, SOURCES, ENABLED, AGED)} select {FIELDS} from aged"),
    "latest_per_source": (latest_per_source, LATEST),
    "dedup_first_wins": (dedup_first_wins, DEDUP),
    "dedup_first_wins_urls": (dedup_urls, DEDUP_URLS),
    "match_catalogue": (match_catalogue, MATCH),
    "needs_update": (needs_update, NEEDS),
    "merge_articles": (merge_articles, MERGE),
    "upsert_catalogue": (upsert_catalogue, UPSERT),
    "prune_catalogue": (prune_catalogue, f"{_ALL} select * from pruned"),
    "removed_entries": (removed_entries, REMOVED),
    "change_report": (change_report, REPORT),
    "high_water_mark": (high_water_mark, HIGH),
    "unique_urls": (unique_urls, UNIQUE),
    "to_catalogue_rows": (to_catalogue_rows, ROWS),
    "clickbait_level": (clickbait_level, CLICK),
    "write_catalogue": (catalogue_round_trip, TRIP),
    "sample_latest": (sample_latest, f"{ctes(STUBS)} select {FIELDS} from stubs order by created_at desc, pos limit 5"),
    "newest_first": (newest_first, f"{ctes(STUBS)} select {FIELDS} from stubs"),
    "spread_by_host": (spread_by_host, SPREAD),
    "valid_times": (valid_times, TIMES),
    "filter_min_length": (filter_min_length, "select doc_id from documents where length(text) >= 300"),
    "source_attribution": (source_attribution, ATTR),
}
