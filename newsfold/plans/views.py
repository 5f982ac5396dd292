"""The test tables as the library's inputs, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfold.operators.catalogue import CLICKBAIT

NOW, SPLIT = "2024-01-31 00:00:00", "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _sha(c: str):
    return F.sha2(F.col(c), 256)


def stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a stub that an outlet (its type) has found at a time."""
    e = table(spark, sf_dir, "events")
    href = F.concat(F.lit("https://"), "event_type", F.lit(".example.org/a/"), F.col("user_id").cast("string"))
    out = e.select(
        F.col("event_id").alias("pos"), F.col("event_type").alias("outlet"), href.alias("href"), F.col("user_id").cast("string").alias("id"),
        (F.col("ts") - F.expr("interval 1 hour")).alias("created_at"), F.col("ts").alias("updated_at"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    sponsored = (F.col("k") % 10 == 0).alias("sponsored")
    return out.select("*", sponsored, F.array(F.struct("href", F.array(F.lit("canonical")).alias("labels"), _sha("href").alias("signature"))).alias("urls"))


STUBS = """
stubs as (
  select event_id as pos, event_type as outlet, 'https://' || event_type || '.example.org/a/' || user_id as href, cast(user_id as varchar) as id,
    ts - interval 1 hour as created_at, ts as updated_at, value, cast(props ->> '$.k' as int) as k,
    cast(props ->> '$.k' as int) % 10 = 0 as sponsored, sha256('https://' || event_type || '.example.org/a/' || user_id) as signature
  from events)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per event type: sizes of the outlets set their limits, and the type error is switched off."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("pos"))
    return g.select(
        F.col("event_type").alias("name"), "pos", (F.col("event_type") != "error").alias("enabled"),
        F.when(F.col("event_type") != "signup", F.lit(21)).alias("max_age_days"), F.when(F.col("event_type") != "view", F.lit(100)).alias("max_num_articles"),
    )


SOURCES = """
sources as (
  select event_type as name, min(event_id) as pos, event_type <> 'error' as enabled,
    case when event_type <> 'signup' then 21 end as max_age_days, case when event_type <> 'view' then 100 end as max_num_articles
  from events group by event_type)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stubs before SPLIT have left: the newest of each URL, reviewed."""
    s = stubs(spark, sf_dir).where(F.col("updated_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    s = s.groupBy("href").agg(F.max_by(F.struct("pos", "outlet", "updated_at", "value"), F.struct("updated_at", "pos")).alias("s")).select("href", "s.*")
    return reviewed(s)


def reviewed(s: DataFrame) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in CLICKBAIT]), (F.least(F.floor(F.col("value") / 10), F.lit(4)) + 1).cast("int"))
    labels = F.when(F.col("value") > 50, F.array(F.lit("paywalled"))).otherwise(F.array().cast("array<string>"))
    return s.select(
        F.col("pos").alias("idx"), F.col("updated_at").alias("updated"), F.array(F.struct(_sha("href").alias("sign"), F.array(F.lit("canonical")).alias("labels"))).alias("urls"),
        F.concat(F.lit("Title "), F.col("pos").cast("string")).alias("title"), level.alias("clickbaitiness"), labels.alias("labels"), "outlet",
    )


CATALOGUE = f"""
catalogue as (
  select pos as idx, updated_at as updated, signature as sign, 'Title ' || pos as title,
    [{', '.join(f"'{x}'" for x in CLICKBAIT)}][least(floor(value / 10), 4)::int + 1] as clickbaitiness, case when value > 50 then 'paywalled' else '' end as labels, outlet
  from (select *, row_number() over (partition by href order by updated_at desc, pos desc) as rn from stubs where updated_at < timestamp '{SPLIT}') where rn = 1)"""


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stubs(spark, sf_dir).where(F.col("updated_at") >= F.lit(SPLIT).cast("timestamp_ntz"))


INCOMING = f"""
incoming as (select * from stubs where updated_at >= timestamp '{SPLIT}')"""


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming stubs as reviewed rows for an upsert."""
    s = incoming(spark, sf_dir)
    title = F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("New "), F.col("pos").cast("string")))
    labels = F.when(F.col("k") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>"))
    rows = s.withColumn("title", title).withColumn("clickbaitiness", F.lit(CLICKBAIT[0])).withColumn("labels", labels)
    from newsfold.operators.catalogue import to_catalogue_rows

    return to_catalogue_rows(rows)


BATCH = """
batch as (
  select pos, updated_at as updated, signature as sign, case when k % 7 = 0 then '' else 'New ' || pos end as title, case when k % 2 = 0 then 'even' else '' end as labels, outlet
  from incoming)"""


def ctes(*parts: str) -> str:
    return "with" + ",".join(parts)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("outlet"), F.col("lang").alias("language"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
