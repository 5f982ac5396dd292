"""Cases that the tables don't hold: ties, nulls, chains, and a sequential model of the order-bound operators."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsfold.functions import markup
from newsfold.functions import text as T
from newsfold.functions import urls as U
from newsfold.functions.graph import connected_components
from newsfold.functions.runtime import lagged, ranked
from newsfold.functions.markup import Page
from newsfold.functions.vectors import HASH, PRIME, hashed_vector
from newsfold.operators import cadence as D
from newsfold.operators import catalogue as C
from newsfold.operators import pages as P
from newsfold.operators import quorum as Q
from newsfold.operators import replies as R
from newsfold.operators import revisions as V
from newsfold.operators import sections as S
from newsfold.operators import stubs as O
from newsfold.sources.feeds import SourceRegistry, discover, json_list_reader, read_json_list_feed
from newsfold.streaming import ingest as I

DAY = datetime(2024, 1, 10)
URLS = "array<struct<href: string, labels: array<string>, signature: string>>"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def first_wins(rows):
    """The sequential definition: (pos, urls, id) in order."""
    seen, ids, out = set(), set(), []
    for pos, urls, i in rows:
        if any(u in seen for u in urls or []):
            continue
        seen.update(urls or [])
        if i is not None:
            if i in ids:
                continue
            ids.add(i)
        out.append(pos)
    return out


def test_dedup_keeps_what_a_dropped_row_would_hide(spark):
    rows = [(0, ["a", "b"], None), (1, ["b", "c"], None), (2, ["c"], None), (3, [], "x"), (4, None, "x"), (5, ["d"], "y"), (6, ["e"], "y"), (7, ["e"], "z")]
    df = spark.createDataFrame(rows, "pos long, urls array<string>, id string")
    assert sorted(r.pos for r in O.dedup_first_wins(df).collect()) == first_wins(rows) == [0, 2, 3, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_is_the_sequential_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(p, [f"u{rnd.randrange(40)}" for _ in range(rnd.randrange(4))], rnd.choice([None, f"i{rnd.randrange(30)}"])) for p in range(60)]
    df = spark.createDataFrame(rows, "pos long, urls array<string>, id string")
    assert sorted(r.pos for r in O.dedup_first_wins(df).collect()) == first_wins(rows)


def test_latest_per_source_limits(spark):
    src = spark.createDataFrame([("a", 0, True, 5, 2), ("b", 1, True, None, None), ("c", 2, False, None, None), ("a", 3, True, 5, 1), (None, 4, True, 1, 1)], "name string, pos long, enabled boolean, max_age_days int, max_num_articles int")
    rows = [(1, "a", DAY, None), (2, "a", DAY, None), (3, "a", datetime(2024, 1, 5), None), (4, "b", None, None), (5, "c", DAY, None), (6, None, DAY, None)]
    df = spark.createDataFrame(rows, "pos long, outlet string, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = O.latest_per_source(df, src, F.lit("2024-01-10").cast("timestamp_ntz"))
    assert sorted(r.pos for r in got.collect()) == [1, 4]  # the last row of a name counts; ties go to the earlier place
    aged = O.filter_max_age(df, src, F.lit("2024-01-10").cast("timestamp_ntz"))
    assert sorted(r.pos for r in aged.collect()) == [1, 2, 3, 4]  # the cut-off itself stays, undated rows too


def test_valid_times_drop_feed(spark):
    df = spark.createDataFrame([("f", 1, DAY, None), ("f", 2, DAY, datetime(2024, 1, 9)), ("g", 3, DAY, DAY), ("h", 4, datetime(2025, 1, 1), None)], "feed string, pos long, created_at timestamp_ntz, updated_at timestamp_ntz")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    assert sorted(r.pos for r in O.valid_times(df, now).collect()) == [1, 3]
    assert [r.pos for r in O.valid_times(df, now, "drop_feed").collect()] == [3]


def test_list_feed_age(spark, tmp_path):
    import json

    df = spark.createDataFrame([("f", 1, DAY, datetime(2024, 1, 30)), ("f", 2, DAY, datetime(2024, 1, 29)), ("g", 3, DAY, None)], "feed string, pos long, created_at timestamp_ntz, updated_at timestamp_ntz")
    now, age = F.lit("2024-01-31").cast("timestamp_ntz"), F.expr("interval 2 days")
    assert [r.pos for r in O.valid_times(df, now, max_age=age).collect()] == [1]
    assert [r.pos for r in O.valid_times(df, now, "drop_feed", max_age=age).collect()] == []
    news = [{"article_id": str(i), "title": "t", "service_name": "s", "published_at": f"2024-01-{d}T00:00:00Z"} for i, d in ((1, 28), (2, 29), (3, 30))]
    (tmp_path / "f.json").write_text(json.dumps({"response": news}))
    got = read_json_list_feed(spark, str(tmp_path / "f.json"), {"s": "https://s/{id}"}, F.lit("2024-01-31").cast("timestamp"), max_age=age, on_error="drop_row")
    assert [r.id for r in got.collect()] == ["3"]


def test_language_of_pages_without_one(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog went to the house", "en"), (2, "der hund und die katze gehen in das haus", "de")], "doc_id long, text string, language string")
    rows = [(1, "u", "<p>the dog and the cat"), (1, "v", "<p>the dog and the cat"), (2, "u", "<p>die katze und der hund"), (3, "u", "<html lang=fr><p>the dog and the cat"), (4, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = P.extract_pages(pages, profiles=P.language_profiles(docs))
    assert sorted((r.page_id, r.language or "") for r in got.collect()) == [(1, "en"), (1, "en"), (2, "de"), (3, "fr"), (4, "")]
    assert got.columns == P.extract_pages(pages).columns


def entries(spark, rows):
    return spark.createDataFrame(rows, "idx long, updated timestamp_ntz, urls array<struct<sign: string, labels: array<string>>>, title string, clickbaitiness string, labels array<string>, outlet string")


def test_upsert_folds_appends_and_replaces(spark):
    old = entries(spark, [(0, DAY, [("s0", ["x"]), ("s9", [])], "old", "c", ["l"], "o"), (1, DAY, [("s1", [])], "one", "c", [], "o")])
    later = datetime(2024, 1, 12)
    batch = spark.createDataFrame(
        [(0, later, [("s0", [])], "", None, ["m"], None), (1, DAY, [("s0", ["y"])], "new", "d", ["l", "n"], "p"), (2, later, [("s7", [])], "seven", "c", [], "o"), (3, later, [("s7", [])], "eight", "", ["z"], "")],
        "pos long, updated timestamp_ntz, urls array<struct<sign: string, labels: array<string>>>, title string, clickbaitiness string, labels array<string>, outlet string",
    )
    got = {r.idx: r for r in C.upsert_catalogue(old, batch).collect()}
    assert got[0].updated == later and got[0].title == "new" and sorted(got[0].labels) == ["l", "m", "n"]
    assert [(u.sign, u.labels) for u in got[0].urls] == [("s0", ["y"])] and got[0].outlet == "p"
    assert got[1].title == "one"
    assert len(got) == 3 and got[max(got)].title == "eight" and got[max(got)].outlet == "o" and got[max(got)].labels == ["z"]
    kept = {r.idx: r for r in C.upsert_catalogue(old, batch, keep_old_urls=True).collect()}
    assert [u.sign for u in kept[0].urls] == ["s0", "s9"]


def test_match_takes_the_first_known_url(spark):
    cat = entries(spark, [(5, DAY, [("b", [])], "", "", [], ""), (6, DAY, [("b", []), ("a", [])], "", "", [], "")])
    art = spark.createDataFrame([(1, [("u", [], "zz"), ("v", [], "a"), ("w", [], "b")]), (2, [("u", [], "")]), (3, [])], f"pos long, urls {URLS}")
    assert {r.pos: r.idx for r in C.match_catalogue(art, cat).collect()} == {1: 6, 2: None, 3: None}


def test_needs_update_is_strict(spark):
    cat = entries(spark, [(0, DAY, [("a", [])], "", "", [], "")])
    art = spark.createDataFrame([(1, DAY, None, [("u", [], "a")]), (2, datetime(2024, 1, 11), None, [("u", [], "a")]), (3, None, None, [("u", [], "a")]), (4, DAY, None, [("u", [], "q")])], f"pos long, created_at timestamp_ntz, updated_at timestamp_ntz, urls {URLS}")
    assert sorted(r.pos for r in C.needs_update(art, cat).collect()) == [2, 3, 4]


def test_unique_urls_prefers_labels_then_order(spark):
    cat = entries(spark, [(0, DAY, [("a", []), ("a", ["x"]), ("b", []), ("b", [])], "", "", [], ""), (1, DAY, [], "", "", [], "")])
    got = {r.idx: [(u.sign, u.labels) for u in r.urls] for r in C.unique_urls(cat).collect()}
    assert got == {0: [("a", ["x"]), ("b", [])], 1: []}


def test_read_catalogue_of_no_file_is_empty(spark, tmp_path):
    assert C.read_catalogue(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    "url,want",
    [("HTTP://Ex.ORG:80", "http://ex.org/"), ("https://ex.org:443/a/./b/../c?x=%c3", "https://ex.org/a/c?x=%C3"), ("https://ex.org:8080/../a/..", "https://ex.org:8080/"), (" mailto:a@b.c ", "mailto:a@b.c"), ("http://e.org/a/b/.", "http://e.org/a/b/")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.lit(url))) == want


def test_signature_without_rule_is_empty(spark):
    rules = [("e\\.org", "/a/([0-9]+)", "/$1")]
    assert one(spark, U.url_signature(F.lit(" https://e.org/a/7?x "), rules)) == one(spark, F.sha2(F.lit("e.org/7"), 256))
    assert one(spark, U.url_signature(F.lit("https://f.org/a/7"), rules)) == "" == one(spark, U.url_signature(F.lit(None).cast("string"), rules))


def test_same_article_falls_back_to_all(spark):
    df = spark.createDataFrame([([("u", ["canonical"], "a"), ("v", [], "b")], [("w", [], "a")]), ([("u", ["canonical"], "a"), ("v", [], "b")], [("w", [], "b")]), ([], [("w", [], "b")])], f"a {URLS}, b {URLS}")
    assert [bool(r.x) for r in df.select(U.same_article(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_titles(spark):
    assert one(spark, T.normalize_title(F.lit(" ﬁne "))) == "fine"
    assert one(spark, T.normalize_title(F.lit(None).cast("string"))) == ""
    assert one(spark, T.clean_text(F.lit("a[12] b ."))) == "a b."
    assert one(spark, T.sentences(F.lit("A b.  C?\n\n d! "))) == ["A b.", "C?", "d!"]


def test_paywall_forms():
    def flag(s):
        return bool(markup.paywall(markup.Page(s))[0])

    ld = '<script type="application/ld+json">{}</script>'
    assert flag(ld.format('{"@type": "NewsArticle", "isAccessibleForFree": "false"}'))
    assert flag(ld.format('[{"@graph": [{"@type": ["X", "WebPage"], "isAccessibleForFree": false}]}]'))
    assert flag(ld.format('{"@type": "Other", "hasPart": [{"isAccessibleForFree": "False"}]}'))
    assert not flag(ld.format('{"@type": "Other", "isAccessibleForFree": false}'))
    assert not flag(ld.format("{broken"))
    assert flag('<p itemprop="isAccessibleForFree">no</p>') and flag('<meta property="schema:isAccessibleForFree" content="0">')
    assert not flag("") and not flag('<meta itemprop="isAccessibleForFree" content="true">')
    assert markup.paywall(markup.Page(ld.format("{broken")))[1]


def test_pages_with_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", None), (2, "http://a.org/y", "<p>hi"), (3, None, "<<<>>>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in P.extract_pages(df).collect()}
    assert got[1].error == "no text" and got[2].text == "hi" and len(got) == 3


def test_sections_levels_and_ignored(spark):
    text = "intro\n# A\nbody a\n### B\nb\n## References\nx\n# C\nlast"
    df = spark.createDataFrame([(1, "en", text), (2, "en", "no heading"), (3, "fi", None)], "doc_id long, language string, text string")
    tree = S.section_parents(S.split_sections(df))
    got = {r.title: (r.level, r.body) for r in tree.collect()}
    assert got == {"A": (1, "body a"), "B": (3, "b"), "C": (1, "last")}
    by = {r.title: r.parent_pos for r in tree.collect()}
    assert by["A"] is None and by["C"] is None and by["B"] == 0
    rolled = {r.title: r.summary for r in S.roll_up(tree, lambda t: F.concat(F.lit("S:"), t)).collect()}
    assert rolled["A"] == "S:A\n\nbody a\n\n<summary>S:B\n\nb</summary>"


def test_replies(spark):
    rows = [(1, '<think>why</think>```json\n{"contemplator": "", "original_title_clickbaitiness": "Slightly Clickbaity", "title": "T'), (2, ""), (3, None), (4, "x"), (5, '{"contemplator": "c", "original_title_clickbaitiness": "Bad", "title": "T"}')]
    df = spark.createDataFrame(rows, "article_id long, reply string")
    got = {r.article_id: r for r in R.parse_replies(df).collect()}
    assert [got[i].error for i in (2, 3, 4, 5)] == ["empty", "empty", "invalid", "scale"]


def test_predict_retries_with_the_error(spark):
    def fn(prompts):
        return ['{"contemplator": "c", "original_title_clickbaitiness": "Slightly Clickbaity", "title": "T"}' if "not accepted" in p else "?" for p in prompts]

    df = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "article_id long, title string, text string")
    good, bad = R.predict(df, fn)
    assert sorted((r.article_id, r.attempt) for r in good.collect()) == [(1, 2), (2, 2)] and bad.count() == 0
    good, bad = R.predict(df, lambda ps: ["?"] * len(ps), max_runs=2)
    assert good.count() == 0 and bad.count() == 2


def test_revisions(spark):
    rows = [(1, i, u, datetime(2024, 1, 1, 0, 0, s), c, t) for i, u, s, c, t in [(10, "a.b", 0, "x", None), (11, "a.b", 0, "y", []), (12, "c", 5, "reverted edits by a.b", None), (13, "d", 9, "reverted edits by axb", ["mw-reverted"])]]
    df = spark.createDataFrame(rows, "pageid long, revid long, user string, ts timestamp_ntz, comment string, tags array<string>")
    assert {r.revid: r.reverted for r in V.reverted_contributions(df).collect()} == {10: True, 11: True, 12: False, 13: True}
    assert {r.revid: r.previous_revid for r in V.previous_notable(df).collect()} == {10: None, 11: None, 12: 11, 13: 12}


def test_power_levels(spark):
    users = spark.createDataFrame([("A", ["Sysop", "sysop", "bot"], None, None), ("B", ["bot"], 5, None), ("C", ["bot"], None, True), ("1.2.3.4", [], None, None), ("::1", None, None, None)], "name string, groups array<string>, blockid long, invalid boolean")
    got = {r.name: r.power for r in V.power_levels(users, spark.createDataFrame([("1.2.3.4",)], "ip string")).collect()}
    assert got == {"A": 210, "B": -9990, "C": 0, "1.2.3.4": -10000, "::1": 0}


def test_quorum_of_one_title(spark):
    df = spark.createDataFrame([(1, 1, -1), (2, 2, 2), (2, 3, 2), (3, 4, 4), (3, 5, 4), (3, 6, -1)], "grp long, id long, cluster long")
    assert {r.grp: (r.cluster, r.label) for r in Q.title_quorum(df).collect()} == {1: (None, None), 2: (2, "unanimous"), 3: (4, "supermajority")}


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(300)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    same = {}
    for r in got:
        same.setdefault(r.root, set()).add(r.node)
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, want.values()))


def test_ranked_is_gapless(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    got = ranked(df, ["k"], [F.col("id")], 7).collect()
    for k in range(3):
        assert sorted(r.rank for r in got if r.k == k) == list(range(sum(1 for r in got if r.k == k)))


def test_registry():
    reg = SourceRegistry()
    a, b = (lambda: "a"), (lambda: "b")
    reg.register("x", "y")(a)
    reg.register("x", weight=60)(b)
    assert reg("x") == "b" and reg("y") == "a" and reg.list() == ["x", "y"] and len(reg) == 2 and "x" in reg and len(reg.all("x")) == 2
    reg.register("x", weight=70)(a)
    assert reg("x") == "a" and len(reg.all("x")) == 2
    with pytest.raises(KeyError):
        reg.get("z")
    reg.clear()
    assert not len(reg)


def test_following_revisions_are_the_next_ones(spark):
    rnd = random.Random(4)
    rows = [(p, i, DAY + timedelta(seconds=rnd.choice([0, 0.4, 1, 1.2, 5, 900]) * rnd.randrange(20))) for i, p in enumerate(rnd.randrange(3) for _ in range(120))]
    want = set()
    for p, i, t in rows:
        later = sorted((t2, j) for q, j, t2 in rows if q == p and t2 >= t + timedelta(seconds=1))
        want |= {(p, i, n + 1, j, t2) for n, (t2, j) in enumerate(later[:3])}
    df = spark.createDataFrame(rows, "pageid long, revid long, ts timestamp_ntz")
    assert {tuple(r) for r in V.following_revisions(df, 3).collect()} == want


@pytest.mark.parametrize("limits", [{"a": 3, "b": None}, {"a": 0, "b": 2}, {"a": None, "b": None}])
def test_newest_per_outlet_is_the_sorted_head(spark, limits):
    rnd = random.Random(1)
    rows = [(p, rnd.choice("aab"), rnd.choice([None, DAY, DAY + timedelta(days=rnd.randrange(4))])) for p in range(80)]
    df = spark.createDataFrame(rows, "pos long, outlet string, updated_at timestamp_ntz").withColumn("created_at", F.col("updated_at"))
    src = spark.createDataFrame([(k, i, True, None, n) for i, (k, n) in enumerate(limits.items())], "name string, pos long, enabled boolean, max_age_days int, max_num_articles int")
    want = {r[0] for k, n in limits.items() for r in sorted((r for r in rows if r[1] == k), key=lambda r: (-(r[2] or datetime.min).timestamp() if r[2] else 1e18, r[0]))[:n]}
    assert {r.pos for r in O.latest_per_source(df, src, F.lit("2024-01-31").cast("timestamp_ntz")).collect()} == want


def list_feed(tmp_path, name, *records):
    import json

    news = [{"article_id": i, "title": "t", "service_name": "S", "published_at": "2024-01-30T00:00:00Z"} | r for i, r in records]
    (tmp_path / name).write_text(json.dumps({"response": news}))
    return str(tmp_path / name)


def test_a_bad_record_ends_its_list_feed(spark, tmp_path):
    now = F.lit("2024-01-31").cast("timestamp")
    bad = [{"service_name": "other"}, {"service_name": None}, {"published_at": "2025-01-01T00:00:00Z"}, {"published_at": "soon"}, {"updated_at": "2024-01-29T12:00:00Z"}, {"published_at": "2024-01-01T00:00:00Z"}]
    for k, r in enumerate(bad):
        path = list_feed(tmp_path, f"{k}.json", ("1", {}), ("2", r), ("3", {"metadata": {"sponsored_content": True}, "service_name": "other"}), ("4", {"published_at": None}))
        assert [x.id for x in read_json_list_feed(spark, path, {"s": "https://s/{id}"}, now).collect()] == [], r
        assert [x.id for x in read_json_list_feed(spark, path, {"s": "https://s/{id}"}, now, on_error="drop_row").collect()] == ["1"], r
    good = list_feed(tmp_path, "good.json", ("1", {"service_name": "s"}), ("2", {"metadata": {"sponsored_content": True}}))
    assert [(x.id, x.href) for x in read_json_list_feed(spark, [good, path], {"s": "https://s/{id}"}, now).collect()] == [("1", "https://s/1")]


def test_discover_goes_on_past_a_dead_url(spark, tmp_path):
    own = SourceRegistry()
    own.register("list")(json_list_reader({"s": "https://s/{id}"}))
    a, b = list_feed(tmp_path, "a.json", ("1", {}), ("2", {})), list_feed(tmp_path, "b.json", ("2", {}), ("3", {}))
    failed, now = [], F.lit("2024-01-31").cast("timestamp")
    dead = str(tmp_path / "dead.json")
    sources = [{"name": "A", "type": "list", "url": [a, dead, b]}, {"name": "B", "type": "list", "url": b}, {"name": "C", "type": "list", "url": dead}, {"name": "D", "type": "none", "url": a, "enabled": False}]
    rows = discover(spark, sources, now, own, failed).orderBy("pos").collect()
    assert [(r.outlet, r.id) for r in rows] == [("A", "1"), ("A", "2"), ("A", "3"), ("B", "2"), ("B", "3")] and len({r.pos for r in rows}) == 5
    assert [f[:2] for f in failed] == [("A", dead), ("C", dead)]
    assert discover(spark, sources[2:], now, own).count() == 0
    with pytest.raises(KeyError):
        discover(spark, [{"name": "E", "type": "none", "url": a}], now, own)


def test_a_restart_without_news_keeps_the_last_catalogue(spark, tmp_path):
    first = entries(spark, [(0, DAY, [("a", [])], "old", "", [], "x")])
    batch = spark.createDataFrame([(k, DAY + timedelta(days=k), [("a", [])], f"t{k}", "", [], "x") for k in range(1, 5)], "pos long, updated timestamp_ntz, urls array<struct<sign: string, labels: array<string>>>, title string, clickbaitiness string, labels array<string>, outlet string")
    sources = spark.createDataFrame([("x", 0, True, None, None)], "name string, pos long, enabled boolean, max_age_days int, max_num_articles int")
    for k in range(1, 5):
        batch.where(F.col("pos") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    now, last = F.lit("2024-01-31").cast("timestamp_ntz"), []
    for _ in range(2):
        store = I.Catalogue(spark, f"{tmp_path}/store", first)
        last.append(I.stream_ingest(I.stream_files(spark, f"{tmp_path}/in", batch.schema, 1), store, sources, now, f"{tmp_path}/check"))
        assert [r.title for r in store.at(last[-1]).collect()] == ["t4"]
    assert last == [3, 3] and len(store._batches()) == 2
    assert I.Catalogue(spark, f"{tmp_path}/new", first).last() == -1


BATCH = "pos long, updated timestamp_ntz, urls array<struct<sign: string, labels: array<string>>>, title string, clickbaitiness string, labels array<string>, outlet string"


def test_a_stream_of_batches_is_upserts_and_prunes_one_after_another(spark, tmp_path):
    rng = random.Random(4)

    def row(k):
        return (k, DAY + timedelta(hours=rng.randint(0, 500)), [(f"s{rng.randint(0, 60)}", []) for _ in range(rng.randint(0, 2))], f"t{k}", "", [], rng.choice(["x", "x", "y", "z", "off"]))

    first = entries(spark, [(k, *row(k)[1:]) for k in range(40)])
    sources = spark.createDataFrame([("x", 0, True, 15, 8), ("y", 1, True, None, 3), ("z", 2, True, 12, None), ("off", 3, False, None, None)], "name string, pos long, enabled boolean, max_age_days int, max_num_articles int")
    now, want, got = F.lit("2024-01-20").cast("timestamp_ntz"), first, None
    batches = [[row(100 * n + k) for k in range(12)] for n in range(4)]
    for n, rows in enumerate(batches):  # two runs of two batches
        df = spark.createDataFrame(rows, BATCH)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        want = spark.createDataFrame(C.prune_catalogue(C.upsert_catalogue(want, df), sources, now).collect(), first.schema)
        if n % 2:
            store = I.Catalogue(spark, f"{tmp_path}/store", first, buckets=7)
            got = store.at(I.stream_ingest(I.stream_files(spark, f"{tmp_path}/in", df.schema, 1), store, sources, now, f"{tmp_path}/check"))
            plain = lambda d: sorted((r.updated, [u.sign for u in r.urls], r.title, r.outlet) for r in d.collect())
            assert plain(got) == plain(want) and got.count() > 10
    assert store.last() == 3 and len(store._batches()) == 2


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    first = spark.range(20_000).select(F.col("id").alias("idx"), F.lit(DAY).cast("timestamp_ntz").alias("updated"), F.array(F.struct(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sign"), F.array().cast("array<string>").alias("labels"))).alias("urls"), F.lit("t").alias("title"), F.lit("").alias("clickbaitiness"), F.array().cast("array<string>").alias("labels"), F.lit("x").alias("outlet"))
    store = I.Catalogue(spark, f"{tmp_path}/store", first, buckets=64)
    sources = spark.createDataFrame([("x", 0, True, None, None)], "name string, pos long, enabled boolean, max_age_days int, max_num_articles int")
    batch = spark.createDataFrame([(k, DAY + timedelta(days=1), [(s, [])], "new", "", [], "x") for k, s in enumerate(["s5", "s9", "own"])], BATCH)
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    last = I.stream_ingest(I.stream_files(spark, f"{tmp_path}/in", batch.schema, 1), store, sources, F.lit("2024-01-20").cast("timestamp_ntz"), f"{tmp_path}/check")
    versions = store._manifest(last)[0]
    assert len(versions) == 64 and 1 <= sum(v == 1 for v in versions.values()) <= 3
    assert store.at(last).count() == 20_001 and store.at(last).where("title = 'new'").count() == 3 and store.at(-1).where("title = 'new'").count() == 0
    store.change(last, store.at(last - 1).where("idx = 5"), spark.createDataFrame([(7,)], "idx long"), 30_000)  # the batch is done again, otherwise
    again = store.at(last)
    assert again.count() == 19_999 and again.where("title = 'new'").count() == 0 and store.top(last) == 30_000


def test_late_rows_are_a_side_output(spark, tmp_path):
    rows = [[(1, 10), (2, 20)], [(3, 9), (4, 14), (5, 30), (6, None)], [(7, 19), (8, 26)]]
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(p, DAY + timedelta(days=d) if d else None) for p, d in part], "pos long, ts timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        in_time, late = I.stream_late(I.stream_files(spark, f"{tmp_path}/in", df.schema, 1), f"{tmp_path}/out", f"{tmp_path}/check", delay="5 days")
        assert sorted(r.pos for r in late.collect()) == [3, 4, 7] and sorted(r.pos for r in in_time.collect()) == [1, 2, 5, 6, 8]


def test_a_key_is_forgotten_after_its_delay(spark, tmp_path):
    hours = [[("a", 0), ("a", 5), ("a", 3), ("b", 4)], [("a", 5), ("a", 6), ("b", 1)], [("c", 900)], [("a", 899)]]
    for part in hours:
        df = spark.createDataFrame([(k, DAY + timedelta(hours=h)) for k, h in part], "signature string, ts timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = I.drain(I.stream_needs_update(I.stream_files(spark, f"{tmp_path}/in", df.schema, 1), delay="2 days"))
    base = int((DAY - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert sorted((r.key, (r.t - base) // 3_600_000_000) for r in out.collect()) == [("a", 0), ("a", 3), ("a", 5), ("a", 6), ("a", 899), ("b", 4), ("c", 900)]


def test_kmeans_scan_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in ((0, 1), (5, 0), (0, 9))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {r.k: r for r in Q.kmeans_scan(df, range(2, 7)).collect()}
    cost = sum(((x[i : i + 30] - x[i : i + 30].mean(0)) ** 2).sum() for i in (0, 30, 60))
    d = ((x[:, None] - x[None]) ** 2).sum(2)  # silhouettes of squared distances
    own = np.repeat([0, 1, 2], 30)
    a = np.array([d[i, own == own[i]].sum() / 29 for i in range(90)])
    b = np.array([min(d[i, own == c].mean() for c in range(3) if c != own[i]) for i in range(90)])
    assert got[3].cost == pytest.approx(cost) and got[3].silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-3)
    assert [k for k, r in got.items() if r.elbow] == [3] == [k for k, r in got.items() if r.best_silhouette]


def test_fit_cadence_is_the_least_squares_polynomial(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.integers(0, 1440, 400)
    y = 30 + 0.1 * m - 1e-4 * m**2 + rng.normal(0, 2, 400)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(m, y, strict=True)], "minutes_since_midnight int, time_diff double")
    start, coefficients = D.fit_cadence(df, 3)
    want = np.polynomial.polynomial.polyfit(m, y, 3)
    at = np.arange(0, 1440, 60.0)
    assert np.polynomial.polynomial.polyval(at, [start, *coefficients]) == pytest.approx(np.polynomial.polynomial.polyval(at, want), abs=1e-4)


def test_hashed_vector_counts_trigrams(spark):
    for text in ("", "ab", "Abcabc d", "éàü éàü", "😀x😀x😀", "漢字かな" * 3000, None):
        c, want = list((text or "").lower()), [0.0] * 16
        for i in range(len(c) - 2):
            want[sum(m * ord(x) for m, x in zip(HASH, c[i : i + 3], strict=True)) % PRIME % 16] += 1
        assert one(spark, hashed_vector(F.lit(text).cast("string"), 16)) == want, text


def test_roll_up_is_the_recursion(spark):
    rows = [(1, 0, 1, "A", "One. Two.", None), (1, 1, 2, "B", "Three. Four.", 0), (1, 2, 3, "C", "<skip> all. Of it.", 1), (1, 3, 2, "D", "", 0), (2, 0, 2, "E", "Six. Seven.", None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, level int, title string, body string, parent_pos int")

    def said(doc, pos):
        r = next(x for x in rows if x[:2] == (doc, pos))
        kids = [s for s in (said(x[0], x[1]) for x in rows if x[0] == doc and x[5] == pos) if s]
        text = "\n\n".join([r[3], *([r[4]] if r[4] else []), *(f"<summary>{k}</summary>" for k in kids)])
        s = " ".join(re.split(r"(?<=[.!?])\s+", text.strip())[:2])
        return "" if "<skip>" in s else s

    got = S.roll_up(df, lambda t: S.first_sentences(t, 2))
    assert {(r.doc_id, r.pos, r.summary) for r in got.collect()} == {(x[0], x[1], said(x[0], x[1])) for x in rows}


def test_token_classifier_learns_and_reports(spark):
    rnd = random.Random(5)
    rows = [(p, 0, i, w, "V" if w.isupper() else "N") for p in range(40) for i, w in enumerate(rnd.choice(["a", "bee", "XX", "YYY", "c1"]) for _ in range(8))]
    f = V.token_features(spark.createDataFrame(rows, "pair_id long, sent int, pos int, token string, label string"))
    out = V.predict_tokens(V.fit_token_classifier(f), f)
    assert out.where("label <> predicted").count() == 0
    report = {r.label: r for r in V.classification_report(out).collect()}
    assert report["weighted"].f1 == 1.0 and report["V"].support == sum(r[4] == "V" for r in rows)


def test_pages_against_their_parts(spark, sf_dir):
    import html

    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    now = F.lit("2024-01-31").cast("timestamp")
    marked = {r.page_id: r.markdown for r in P.html_to_markdown(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    rows = P.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), now).collect()
    assert len(rows) == len(src)
    for r in rows:
        page = src[r.page_id]
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        words = html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split()
        assert r.text.split() == words and r.title.split() == html.unescape(re.search("<title>(.*?)</title>", page, re.S)[1]).split()
        assert r.language == re.search('lang="(..)', page)[1] and not r.paywalled and r.error is None
        head = html.unescape(re.sub("<[^>]*>", "", re.search("<h1>(.*?)</h1>", article, re.S)[1])).split()
        assert marked[r.page_id].split("\n\n")[0].split() == ["#", *head]
        assert marked[r.page_id].replace("*", "").split()[1:] == " ".join(words).replace("*", "").split()


def test_lagged_is_the_row_before(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), p, rnd.choice([None, 1, 2, 3])) for p in rnd.sample(range(300), 120)]
    want = {}
    for k in ("a", "b", None):
        own = sorted(r[1:] for r in rows if r[0] == k)
        want |= {p: before for (p, _), (_, before) in zip(own, [(None, None), *own], strict=False)}
    df = spark.createDataFrame(rows, "k string, pos long, v int").withColumn("__key", F.lit(1))
    got = lagged(df, "k", "pos", F.floor(F.col("pos") / 7), "before", "v")
    assert {r.pos: r.before for r in got.collect()} == want and got.columns == [*df.columns, "before"]


@pytest.mark.parametrize("html,markdown", [
    ("<p><b>one <br><p>two", "**one**\n\ntwo"),
    ("<article><p><b>a<p><i>b<p>c <b>d </b>e</article>f", "**a**\n\n*b*\n\nc **d** e\n\nf"),
    ("<p>a <b>b", "a **b**"),
    ("<p>a<nav><p>b</nav> c</p>d", "a\n\nc\n\nd"),
    ("<p>a<span class=ad><p>b</p></span> c", "a\n\nc"),
    ("<p>a <b><nav><b>x</b></nav>y</b>", "a **y**"),
    ("<table><tr><td><p>a<table><tr><td><p>b</table></table>", "a\n\nb"),
    ("<p>a <b> </b><a href=x>b </a>c", "a [b](x) c"),
    ("<ul><li>a<li><p>b<li>c</ul>", "- a\n\nb\n\n- c"),
    ("<title>t<p>x", ""),
    ("", ""),
])
def test_paragraphs_and_marks_end_where_html_ends_them(html, markdown):
    assert Page(html).markdown() == markdown and Page(html).error is None
