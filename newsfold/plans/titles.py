"""Queries of the quorum and cadence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsfold.functions.vectors import HASH, PRIME, hashed_vector
from newsfold.operators import cadence as C
from newsfold.operators import quorum as Q
from newsfold.plans import views as V


def _titles(spark, d):
    """Vectors dealt to groups of ten by label and place, as an article's titles."""
    e = V.table(spark, d, "embeddings")
    return e.select((F.floor(F.col("vec_id") / 100) * 10 + F.col("label")).alias("grp"), F.col("vec_id").alias("id"), "embedding")


T = """
t as (select vec_id // 100 * 10 + label as grp, vec_id as id, embedding::double[] as v from embeddings),
p as (select a.grp, a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as sim from t a join t b on a.grp = b.grp and a.id < b.id)"""


def pairwise_similarity(spark, d):
    return Q.pairwise_similarity(_titles(spark, d)).select("grp", "a", "b", F.round("sim", 6).alias("sim"))


def group_cohesion(spark, d):
    return Q.group_cohesion(_titles(spark, d)).select("grp", "n", F.round("cohesion", 6).alias("cohesion"))


COHESION = f"with {T}, m as (select grp, avg(sim) as s from p group by grp), n as (select grp, count(*) as n from t group by grp) select grp, n, round(s, 6) as cohesion from n left join m using (grp)"


def rank_by_centroid(spark, d):
    return Q.rank_by_centroid(_titles(spark, d)).select("grp", "id", F.round("sim", 6).alias("sim"), "rank")


CENTROID = """
e as (select grp, unnest(v) as x, generate_subscripts(v, 1) as i from t), m as (select grp, i, avg(x) as x from e group by all),
c as (select grp, list(x order by i) as c from m group by grp),
s as (select grp, id, list_cosine_similarity(v, c) as sim from t join c using (grp))"""


def article_similarity(spark, d):
    t = _titles(spark, d)
    first = t.groupBy("grp").agg(F.min_by("embedding", "id").alias("article"))
    return Q.article_similarity(t, first).select("grp", "id", F.round("sim", 6).alias("sim"), F.round("mean_sim", 6).alias("mean_sim"))


ARTICLE = f"with {T}, f as (select grp, arg_min(v, id) as f from t group by grp), s as (select grp, id, list_cosine_similarity(v, f) as s from t join f using (grp)) select grp, id, round(s, 6) as sim, round(avg(s) over (partition by grp), 6) as mean_sim from s"


def kmeans_scan(spark, d):
    return Q.kmeans_scan(_titles(spark, d), range(2, 13))


EPS = 0.75


def eps_components(spark, d):
    return Q.eps_components(_titles(spark, d), EPS)


LINKED = f"""
with recursive {T}, e as (select a, b from p where 1 - sim <= {EPS} union all select b, a from p where 1 - sim <= {EPS}),
r as (select distinct a as id, a as c from e union select e.b, r.c from r join e on e.a = r.id),
k as (select id, min(c) as cluster from r group by id),
cl as (select grp, id, coalesce(cluster, -1) as cluster from t left join k using (id))"""


def title_quorum(spark, d):
    return Q.title_quorum(Q.eps_components(_titles(spark, d), EPS)).select("grp", "cluster", F.round("share", 6).alias("share"), "label")


QUORUM = f"""{LINKED}, n as (select grp, cluster, count(*) as n from cl group by all), s as (select grp, sum(n) as total from n group by grp),
b as (select *, row_number() over (partition by grp order by n desc, cluster) as rn from n where cluster <> -1),
j as (select s.grp, b.cluster, coalesce(b.n / total, 0) as share from s left join b on b.grp = s.grp and rn = 1)
select grp, cluster, round(share, 6) as share, case when share = 1 then 'unanimous' when share >= 2 / 3 then 'supermajority' when share > 0.5 then 'consensus' end as label from j"""


def tfidf_top_terms(spark, d):
    return Q.tfidf_top_terms(V.articles(spark, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"), "rank")


TFIDF = r"""
with d as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda w: w not in (STOP)) as w from documents),
e as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
g as (select doc_id, x as term from e union all select doc_id, x || ' ' || y from (select doc_id, x, lead(x) over (partition by doc_id order by i) as y from e) where y is not null),
tf as (select doc_id, term, count(*) as tf from g group by all), df as (select term, count(*) as df from tf group by term),
x as (select doc_id, term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as x from tf join df using (term)),
n as (select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 9) as weight from x),
r as (select *, row_number() over (partition by doc_id order by weight desc, term) as rank from n)
select doc_id, term, round(weight, 6) as weight, rank::int as rank from r where rank <= 10"""


def entity_jaccard(spark, d):
    """The capitalised words of a document's lines against those of its first line."""
    docs = V.articles(spark, d)
    caps = F.array_distinct(F.regexp_extract_all(F.col("line"), F.lit("[A-Z][a-z]{2,}"), F.lit(0)))
    lines = docs.select(F.col("doc_id").alias("grp"), F.array_distinct(F.regexp_extract_all(F.substring_index("text", "\n", 1), F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("article_entities"), F.posexplode(F.split("text", "\n")).alias("id", "line"))
    rows = Q.entity_jaccard(lines.select("grp", "id", caps.alias("entities"), "article_entities"))
    return rows.select("grp", "id", F.round("jaccard", 6).alias("jaccard"), F.size("common").cast("long").alias("n_common"), "rank")


JACCARD = r"""
with l as (select doc_id as grp, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as id, list_distinct(regexp_extract_all(string_split(text, chr(10))[1], '[A-Z][a-z]{2,}')) as a from documents),
e as (select grp, id, list_distinct(regexp_extract_all(line, '[A-Z][a-z]{2,}')) as e, a from l),
j as (select grp, id, len(list_intersect(e, a)) as n_common, len(list_distinct(list_concat(e, a))) as u from e),
s as (select grp, id, case when u > 0 then round(n_common / u, 12) end as s, n_common from j)
select grp, id, round(s, 6) as jaccard, n_common::bigint as n_common, (row_number() over (partition by grp order by s desc nulls last, id))::int as rank from s"""


def hashed_vectors(spark, d):
    """Trigram vectors of the pages' titles."""
    t = V.pages(spark, d).select("page_id", hashed_vector(F.regexp_extract("html", "<title>([^<]*)", 1), 32).alias("v"))
    return t.select("page_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), " ").alias("v"))


VECTORS = f"""
with t as (select page_id, list_transform(list_filter(string_split(lower(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1)), ''), lambda x: x <> ''), lambda x: unicode(x)::bigint) as c from pages),
g as (select page_id, list_transform(range(1, len(c) - 1), lambda i: (c[i] * {HASH[0]} + c[i + 1] * {HASH[1]} + c[i + 2] * {HASH[2]}) % {PRIME} % 32) as g from t)
select page_id, array_to_string(list_transform(range(32), lambda k: len(list_filter(g, lambda x: x = k))), ' ') as v from g"""


def _log(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.col("event_type").alias("outlet"), F.col("event_id").alias("pos"), F.col("ts").alias("published_at"), F.when(F.col("user_id") % 10 == 0, F.col("ts")).alias("updated_at"))


LOG = "log as (select event_type as outlet, event_id as pos, ts as published_at, case when user_id % 10 = 0 then ts end as updated_at from events)"
ARRIVE = """
b as (select outlet, published_at, lag(published_at) over (partition by outlet order by published_at) as before from log where updated_at is null),
a as (select outlet, published_at, date_diff('microsecond', before, published_at) / 60e6 as time_diff, extract(hour from published_at) * 60 + extract(minute from published_at) as m from b where before is not null)"""


def inter_arrival(spark, d):
    r = C.inter_arrival(_log(spark, d))
    return r.select("outlet", "published_at", "time_diff", F.col("minutes_since_midnight").cast("long").alias("minutes_since_midnight"))


def check_publish_log(spark, d):
    """Backwards, every row after the first of an outlet is later than the one before; so read by value instead."""
    log = _log(spark, d).join(V.table(spark, d, "events").select(F.col("event_id").alias("pos"), "value"), "pos")
    return C.check_publish_log(log.withColumn("pos", F.struct("value", "pos")), "pos", F.floor("value")).select("outlet", "published_at", "previous")


CHECK = "with r as (select event_type as outlet, ts as published_at, lag(ts) over (partition by event_type order by value, event_id) as previous from events where user_id % 10 <> 0) select * from r where published_at > previous"
#: An outlet's fitted cadence.
CADENCE = (109.0018, (-0.7748, 2.0854e-3, -2.4559e-6, 1.2410e-9, -1.9835e-13))


def next_scan_at(spark, d):
    last = _log(spark, d).groupBy("outlet", F.to_date("published_at").alias("day")).agg(F.max("published_at").alias("last_at"))
    return C.next_scan_at(last, CADENCE).select("outlet", "last_at", F.round("delay", 6).alias("delay"))


_POLY = " + ".join(f"({c}) * m ** {i + 1}" for i, c in enumerate(CADENCE[1]))
SCAN = f"with {LOG}, l as (select outlet, max(published_at) as last_at from log group by outlet, published_at::date), m as (select *, (extract(hour from last_at) * 60 + extract(minute from last_at))::double as m from l) select outlet, last_at, round({CADENCE[0]} + {_POLY}, 6) as delay from m"


def regression_error(spark, d):
    rows = C.inter_arrival(_log(spark, d)).withColumn("predicted", C.estimated_delay(F.col("published_at"), CADENCE))
    return C.regression_error(rows, "time_diff", "predicted", "outlet").select("outlet", "n", F.round("mae", 5).alias("mae"), F.round("mse", 4).alias("mse"))


ERROR = f"with {LOG}, {ARRIVE}, e as (select outlet, {CADENCE[0]} + {_POLY} - time_diff as e from (select outlet, time_diff, m::double as m from a)) select outlet, count(*) as n, round(avg(abs(e)), 5) as mae, round(avg(e * e), 4) as mse from e group by outlet"


def fit_cadence(spark, d):
    """Each outlet's model of degree five, judged on what it was fitted to."""
    rows = C.inter_arrival(_log(spark, d))
    said = C.with_delay(rows, C.fit_cadences(rows), "published_at")
    return C.regression_error(said, "time_diff", "delay", "outlet").select("outlet", "n", F.round("mae", 5).alias("mae"), F.round("mse", 4).alias("mse"))


#: The same fit by polynomials that are orthogonal over an outlet's arrivals: p is the one of a degree, o the one before it, f the fit so far.
ORTHOGONAL = ", ".join(
    f"""l{k + 1} as (select outlet, y, x, (x - xp / n2) * p - coalesce(n2 / nullif(o2, 0), 0) * o as p, p as o, f + yp / n2 * p as f
  from (select *, sum(p * p) over w as n2, sum(o * o) over w as o2, sum(x * p * p) over w as xp, sum(y * p) over w as yp from l{k} window w as (partition by outlet)))"""
    for k in range(6)
)
FIT = f"""with {LOG}, {ARRIVE}, l0 as (select outlet, time_diff as y, m / 720.0::double - 1 as x, 1.0::double as p, 0.0::double as o, 0.0::double as f from a), {ORTHOGONAL}
select outlet, count(*) as n, round(avg(abs(f - y)), 5) as mae, round(avg((f - y) ** 2), 4) as mse from l6 group by outlet"""


def cadence_moments(spark, d):
    m = C.cadence_moments(C.inter_arrival(_log(spark, d)), 2)
    return m.select("outlet", "n", *[F.round(F.col("powers")[k], 5).alias(f"p{k}") for k in range(5)], *[F.round(F.col("products")[k], 4).alias(f"q{k}") for k in range(3)])


MOMENTS = f"with {LOG}, {ARRIVE}, x as (select outlet, time_diff as y, m / 720.0::double - 1 as x from a) select outlet, count(*) as n, {', '.join(f'round(sum(x ** {k}), 5) as p{k}' for k in range(5))}, {', '.join(f'round(sum(x ** {k} * y), 4) as q{k}' for k in range(3))} from x group by outlet"


def fit_cadence_line(spark, d):
    """Each outlet's model of degree one."""
    f = C.fit_cadences(C.inter_arrival(_log(spark, d)), 1)
    return f.select("outlet", "n", F.round("intercept", 5).alias("intercept"), F.round(F.col("coefficients")[0], 7).alias("slope"))


LINE = f"with {LOG}, {ARRIVE} select outlet, count(*) as n, round(regr_intercept(time_diff, m), 5) as intercept, round(regr_slope(time_diff, m), 7) as slope from a group by outlet"

QUERIES = {
    "pairwise_similarity": (pairwise_similarity, f"with {T} select grp, a, b, round(sim, 6) as sim from p"),
    "group_cohesion": (group_cohesion, COHESION),
    "rank_by_centroid": (rank_by_centroid, f"with {T}, {CENTROID} select grp, id, round(sim, 6) as sim, (row_number() over (partition by grp order by round(sim, 9) desc, id))::int as rank from s"),
    "article_similarity": (article_similarity, ARTICLE),
    "kmeans_scan": (kmeans_scan, None),
    "eps_components": (eps_components, f"{LINKED} select * from cl"),
    "title_quorum": (title_quorum, QUORUM),
    "tfidf_top_terms": (tfidf_top_terms, TFIDF.replace("STOP", ", ".join(f"'{w}'" for w in Q.STOP_WORDS))),
    "entity_jaccard": (entity_jaccard, JACCARD),
    "hashed_vectors": (hashed_vectors, VECTORS),
    "inter_arrival": (inter_arrival, f"with {LOG}, {ARRIVE} select outlet, published_at, time_diff, m as minutes_since_midnight from a"),
    "check_publish_log": (check_publish_log, CHECK),
    "next_scan_at": (next_scan_at, SCAN),
    "regression_error": (regression_error, ERROR),
    "fit_cadence": (fit_cadence, FIT),
    "cadence_moments": (cadence_moments, MOMENTS),
    "fit_cadence_line": (fit_cadence_line, LINE),
}
