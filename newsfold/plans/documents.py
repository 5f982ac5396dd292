"""Queries of the section, storyline and reply operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfold.operators import replies as R
from newsfold.operators import sections as S
from newsfold.operators import storyline as L
from newsfold.operators.catalogue import CLICKBAIT
from newsfold.plans import views as V


def _headed(spark, d):
    """Documents in which every third line is a heading of level 1 to 4, by its place."""
    docs = V.articles(spark, d)
    mark = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (F.pmod(F.col("doc_id") + i * i, F.lit(4)) + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    return docs.withColumn("text", F.array_join(mark, "\n"))


HEADED = r"""
ln as (select doc_id, x, i from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)),
sec as (select doc_id, (i // 3)::int as pos, ((doc_id + (i // 3) * 3 * (i // 3) * 3) % 4 + 1)::int as level, trim(any_value(x) filter (where i % 3 = 0)) as title,
  regexp_replace(coalesce(string_agg(x, chr(10) order by i) filter (where i % 3 <> 0), ''), '^\s+|\s+$', '', 'g') as body from ln group by doc_id, i // 3),
par as (select s.*, (select max(p.pos) from sec p where p.doc_id = s.doc_id and p.pos < s.pos and p.level < s.level) as parent_pos from sec s)"""


def split_sections(spark, d):
    return S.split_sections(_headed(spark, d))


def _tree(spark, d):
    return S.section_parents(S.split_sections(_headed(spark, d)))


def section_parents(spark, d):
    return _tree(spark, d).select("doc_id", "pos", "level", "parent_pos")


def section_documents(spark, d):
    tree = _tree(spark, d).withColumn("summary", F.col("body"))
    return S.section_documents(tree).select("doc_id", "pos", F.md5("path").alias("path"), F.md5("text").alias("text"))


DOCS = f"""with recursive {HEADED},
n as (select doc_id, pos, parent_pos, title, body, concat_ws(chr(10) || chr(10), title, nullif(body, '')) as intro from par),
a as (select doc_id, pos, parent_pos as up, title as path, body as text from n
  union all select a.doc_id, a.pos, n.parent_pos, n.title || ' > ' || a.path, n.intro || case when n.intro <> '' and a.text <> '' then chr(10) || chr(10) else '' end || a.text
  from a join n on n.doc_id = a.doc_id and n.pos = a.up)
select doc_id, pos, md5(path) as path, md5(text) as text from a where up is null"""


def roll_up(spark, d):
    return S.roll_up(_tree(spark, d)).select("doc_id", "pos", "level", F.length("summary").alias("n"), F.md5("summary").alias("summary"))


def _level(k):
    """The sections of level k (four at most) with their summaries, in SQL; the first sentence ends at the first mark before white space."""
    kids = " union all ".join(f"select * from s{j}" for j in range(k + 1, 5))
    kids = f"(select string_agg('<summary>' || summary || '</summary>', chr(10) || chr(10) order by x.pos) from ({kids}) x where x.doc_id = p.doc_id and x.parent_pos = p.pos and summary <> '')" if kids else "null"
    first = r"case when regexp_matches(t, '(?s)[.!?]\s') then regexp_extract(t, '(?s)^(.*?[.!?])\s', 1) else t end"
    return f"s{k} as (select doc_id, pos, level, parent_pos, case when contains(f, '<skip>') then '' else f end as summary from (select *, {first} as f from (select *, trim(concat_ws(chr(10) || chr(10), title, nullif(body, ''), {kids})) as t from par p where level = {k})))"


ROLLED = f"with {HEADED}, {', '.join(_level(k) for k in (4, 3, 2, 1))} select doc_id, pos, level, length(summary)::int as n, md5(summary) as summary from ({' union all '.join(f'select * from s{k}' for k in (4, 3, 2, 1))})"


def _stories(spark, d):
    """A document as a story: its first line the header, then rich text, quotes, headings, adverts by place."""
    lines = F.split("text", "\n")

    def block(x, i):
        k = F.when(i == 0, F.lit("header")).otherwise(F.element_at(F.array(*[F.lit(t) for t in ("rich_text", "quote", "heading", "ad_container", "map")]), (i % 5 + 1).cast("int")))
        text = F.struct(F.lit("text").alias("type"), F.struct(x.alias("text")).alias("data"))
        link = F.struct(F.lit("link").alias("type"), F.struct(F.lit("more").alias("text")).alias("data"))
        data = F.to_json(F.struct(x.alias("text"), x.alias("headline"), x.alias("ingress"), F.lit("Somebody").alias("attribution"), i.alias("level"), F.array(text, link).alias("items")))
        return F.struct(k.alias("type"), data.alias("data"))

    return V.articles(spark, d).select("doc_id", F.transform(lines, block).alias("storyline"))


def storyline_text(spark, d):
    return _stories(spark, d).select("doc_id", F.md5(L.storyline_text(F.col("storyline"))).alias("text"))


STORY = """
ln as (select doc_id, x, i from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents))"""
TEXT = f"""with {STORY}, b as (select doc_id, i, case when i = 0 then x when i % 5 = 0 then x when i % 5 = 1 then '"' || x || '"' || chr(10) || '— Somebody' end as s from ln)
select doc_id, md5(coalesce(string_agg(s, chr(10) || chr(10) order by i) filter (where s <> ''), '')) as text from b group by doc_id"""


def storyline_markdown(spark, d):
    return _stories(spark, d).select("doc_id", F.md5(L.storyline_markdown(F.col("storyline"))).alias("text"))


MARKDOWN = f"""with {STORY}, b as (select doc_id, i, case when i = 0 then '# ' || x || chr(10) || chr(10) || x when i % 5 = 0 then x || 'more' when i % 5 = 1 then '> ' || x
  when i % 5 = 2 then repeat('#', least(6, i)::int) || ' ' || x when i % 5 = 4 then '<!-- map -->' end as s from ln)
select doc_id, md5(coalesce(string_agg(s, chr(10) || chr(10) order by i) filter (where s <> ''), '')) as text from b group by doc_id"""


def parse_story_payload(spark, d):
    s = _stories(spark, d)
    meta = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Headline "), F.col("doc_id").cast("string")).alias("headline"), F.lit("2024-01-05T10:00:00Z").alias("published_at"), F.when(F.col("doc_id") % 2 == 0, F.lit("locked")).otherwise(F.lit("free")).alias("access_level"), F.when(F.col("doc_id") % 3 == 0, F.lit("Firm")).alias("advertiser"))
    body = F.to_json(F.struct((F.col("doc_id") % 5 != 0).alias("ok"), F.struct(meta.alias("meta"), F.col("storyline")).alias("data")))
    stubs = s.select("doc_id", F.lit("Stub").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.array().cast("array<string>").alias("labels"), body.alias("payload"))
    out = L.parse_story_payload(stubs)
    return out.select("doc_id", "title", F.col("created_at").cast("string").alias("created_at"), F.array_join("labels", " ").alias("labels"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


PAYLOAD = f"""with t as ({TEXT.replace('md5(coalesce(string_agg', '(coalesce(string_agg')})
select doc_id, case when ok then 'Headline ' || doc_id else 'Stub' end as title, case when ok then '2024-01-05 10:00:00' else '2024-01-01 00:00:00' end as created_at,
  case when ok then concat_ws(' ', case when doc_id % 2 = 0 then 'paywalled' end, case when doc_id % 3 = 0 then 'sponsored' end) else '' end as labels, md5(case when ok then text else '' end) as text
from (select *, doc_id % 5 <> 0 and text <> '' as ok from t)"""


def _replies(spark, d):
    """Assistant turns as replies: fenced, thought over, cut off, wrong or empty, by the turn's id."""
    c = V.table(spark, d, "conversations").where("role = 'assistant'").withColumn("article_id", F.col("conv_id") * 100 + F.col("turn"))
    k = F.col("article_id") % 7
    level = F.when(k == 5, F.lit("Rather")).otherwise(F.lit(CLICKBAIT[1]))
    json = F.to_json(F.struct(F.when(k == 1, F.lit("")).otherwise(F.lit("because")).alias("contemplator"), level.alias("original_title_clickbaitiness"), F.col("text").alias("title")))
    reply = (
        F.when(k == 0, F.concat(F.lit("```json\n{}\n```\nBetter:\n```json\n"), json, F.lit("\n```"))).when(k == 1, F.concat(F.lit("<think>deep</think>"), json))
        .when(k == 3, F.lit("")).when(k == 4, F.lit("no json")).otherwise(json)
    )
    out = c.withColumn("reply", reply)
    return out.withColumn("reply", F.when(k == 2, F.expr("substring(reply, 1, length(reply) - 2)")).otherwise(F.col("reply"))).select("article_id", "text", "reply")


def parse_replies(spark, d):
    p = R.parse_replies(_replies(spark, d), "contemplator string, original_title_clickbaitiness string, title string")
    return p.select("article_id", "error", F.col("value.contemplator").alias("why"), F.col("value.title").alias("title"))


REPLIES = """with c as (select conv_id * 100 + turn as article_id, text, (conv_id * 100 + turn) % 7 as k from conversations where role = 'assistant')
select article_id, case k when 3 then 'empty' when 4 then 'invalid' when 5 then 'scale' end as error, case when k in (3, 4, 5) then null when k = 1 then 'deep' else 'because' end as why,
  case when k = 2 then rtrim(text, ' ') when k not in (3, 4, 5) then text end as title from c"""


def render_prompt(spark, d):
    a = V.articles(spark, d).select("doc_id", F.concat(F.lit("<b>A & B</b> "), F.col("doc_id").cast("string")).alias("title"), "text", F.when(F.col("doc_id") % 2 == 0, F.lit("Old")).alias("old_title"), F.lit(CLICKBAIT[0]).alias("old_level"))
    return R.render_prompt(a, "title string").select("doc_id", F.md5("prompt").alias("md5"))


PROMPT = f"""select doc_id, md5(concat_ws(chr(10) || chr(10), 'Title: A &amp; B ' || doc_id, 'Text:' || chr(10) || '    ' || replace(text, chr(10), chr(10) || '    '),
  case when doc_id % 2 = 0 then 'Stored title: Old ({CLICKBAIT[0]})' end, 'Answer with JSON of this form: title string')) as md5 from documents"""


def echo(prompts: list[str]) -> list[str]:
    """A predictor that needs no model: it answers a title from the prompt, and fails the first time for long prompts."""
    import json

    out = []
    for p in prompts:
        title = p.split("\n", 1)[0].removeprefix("Title: ")
        good = json.dumps({"contemplator": "echo", "original_title_clickbaitiness": CLICKBAIT[0], "title": title.upper()})
        out.append(good if len(p) < 1500 or "not accepted" in p else "no answer")
    return out


def predict(spark, d):
    a = V.articles(spark, d).select(F.col("doc_id").alias("article_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    good, _ = R.predict(a, echo, schema="contemplator string, original_title_clickbaitiness string, title string")
    return good.select("article_id", "attempt", F.col("value.title").alias("title"))


PREDICT = """select doc_id as article_id, case when length(concat_ws(chr(10) || chr(10), 'Title: doc ' || doc_id, 'Text:' || chr(10) || '    ' || replace(text, chr(10), chr(10) || '    '),
  'Answer with JSON of this form: contemplator string, original_title_clickbaitiness string, title string')) < 1500 then 1 else 2 end as attempt, 'DOC ' || doc_id as title from documents"""

QUERIES = {
    "split_sections": (split_sections, f"with {HEADED} select doc_id, pos, level, title, body from sec"),
    "section_parents": (section_parents, f"with {HEADED} select doc_id, pos, level, parent_pos from par"),
    "section_documents": (section_documents, DOCS),
    "roll_up": (roll_up, ROLLED),
    "storyline_text": (storyline_text, TEXT),
    "storyline_markdown": (storyline_markdown, MARKDOWN),
    "parse_story_payload": (parse_story_payload, PAYLOAD),
    "parse_replies": (parse_replies, REPLIES),
    "render_prompt": (render_prompt, PROMPT),
    "predict": (predict, PREDICT),
}
