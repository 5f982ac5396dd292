"""Operators that must not put a page, a group, a host or a chain into one task: against plain models, with small bounds."""

import random
from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsfold.functions import runtime
from newsfold.operators import cadence as D
from newsfold.operators import quorum as Q
from newsfold.operators import revisions as R
from newsfold.operators import stubs as S

T0 = datetime(2024, 1, 1)


def revisions(seed, n=300, pages=3):
    """Bursts within a second, a hot page, equal times, and a page of one revision."""
    rng, at, rows = random.Random(seed), 0.0, []
    for k in range(n):
        at += rng.choice([0, 0, 0.0001, 0.2, 0.9999, 1.0, 5.0, 90_000.0])
        rows.append((rng.choice([1] * 6 + list(range(1, pages + 1))), k, f"u{rng.randint(0, 3)}", T0 + timedelta(seconds=at)))
    return [*rows, (99, 10_000, "u0", T0), (None, 10_001, "u1", T0), (1, 10_002, "u1", None)]


REV = "pageid long, revid long, user string, ts timestamp_ntz"


def following(rows, n):
    out = set()
    for p, r, _, t in rows:
        if p is None or t is None:
            continue
        later = sorted((x[3], x[1]) for x in rows if x[0] == p and x[3] and x[3] >= t + timedelta(seconds=1))
        out |= {(p, r, k + 1, nr, nt) for k, (nt, nr) in enumerate(later[:n])}
    return out


@pytest.mark.parametrize("per_part", [3, 40, 200_000])
def test_following_revisions_over_bucket_ends(spark, monkeypatch, per_part):
    monkeypatch.setattr(R, "in_order", partial(runtime.in_order, per_part=per_part))
    rows = revisions(per_part)
    got = R.following_revisions(spark.createDataFrame(rows, REV).withColumn("bucket", F.lit(1)), 4)
    assert {tuple(r) for r in got.collect()} == following(rows, 4)
    assert R.following_revisions(spark.createDataFrame([], REV), 3).count() == 0


@pytest.mark.parametrize("per_part", [3, 40, 200_000])
def test_previous_notable_over_bucket_ends(spark, monkeypatch, per_part):
    monkeypatch.setattr(R, "in_order", partial(runtime.in_order, per_part=per_part))
    rows = [r for r in revisions(per_part + 1) if r[0] is not None and r[3] is not None]
    want = set()
    for p in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[1]))
        for k, r in enumerate(own):
            old = [x for x in own[max(0, k - 7) : k] if x[2] != r[2] or x[3] <= r[3] - timedelta(days=1)]
            want.add((p, r[1], old[-1][1] if old else None))
    assert {tuple(r) for r in R.previous_notable(spark.createDataFrame(rows, REV), 7).collect()} == want


def test_no_task_has_a_whole_page(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("pageid"), (F.col("id") % 50).alias("x"))
    both, starts = runtime.in_order(rows, ["pageid", "x"], "b", "r", per_part=1000)
    sizes = [r["size"] for r in starts.collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000 and sorted(r.r for r in both.collect()) == list(range(20_000))


def walk(rows):
    held, out = set(), []
    for pos, urls in sorted(rows):
        if held.isdisjoint(urls):
            held |= set(urls)
            out.append(pos)
    return out


@pytest.mark.parametrize("walk_rows", [0, 12, 50_000])
def test_dedup_of_url_arrays_is_the_walk(spark, walk_rows):
    rng = random.Random(walk_rows)
    rows = [(k, [f"u{rng.randint(0, 150)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for k in range(200)]
    df = spark.createDataFrame(rows, "pos long, urls array<string>").withColumn("id", F.lit(None).cast("string")).withColumn("root", F.lit(1))
    assert sorted(r.pos for r in S.dedup_first_wins(df, walk_rows=walk_rows).collect()) == walk(rows)


def test_a_chain_of_stubs_takes_few_jobs(spark):
    rows = [(k, [f"u{k}", f"u{k + 1}"]) for k in range(2000)]
    df = spark.createDataFrame(rows, "pos long, urls array<string>").withColumn("id", F.lit(None).cast("string"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = sorted(r.pos for r in S.dedup_first_wins(df).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert got == list(range(0, 2000, 2)) and jobs < 250


def robots(urls, rules):
    out = set()
    for host, path in urls:
        fit = sorted((pos, allow) for h, p, allow, pos in rules if h == host and p is not None and path.startswith(p))
        out.add((f"https://{host}{path}", fit[0][1] if fit else True))
    return out


def test_robots_by_the_first_rule(spark):
    rng = random.Random(1)
    piece = lambda: "".join(rng.choice("/ab") for _ in range(rng.randint(0, 5)))
    urls = [(rng.choice(["x.org", "y.org", "z.org"]), "/" + piece()) for _ in range(200)]
    rules = [(rng.choice(["x.org", "y.org"]), rng.choice(["/" + piece(), "", "/"]) if k % 9 else None, rng.random() < 0.5, k) for k in range(60)]
    df = spark.createDataFrame([(f"https://{h}{p}",) for h, p in urls], "href string")
    r = spark.createDataFrame([(h, "*", p, a, k) for h, p, a, k in rules] + [("x.org", "other", "/", False, -1)], "host string, agent string, prefix string, allow boolean, pos long")
    assert {tuple(x) for x in S.robots_filter(df, r, "me").distinct().collect()} == robots(urls, rules)


def test_robots_of_a_host_with_many_rules(spark):
    rules = spark.range(10_000).select(F.lit("x.org").alias("host"), F.lit("*").alias("agent"), F.concat(F.lit("/r"), F.col("id").cast("string"), F.lit("/")).alias("prefix"), (F.col("id") % 2 == 0).alias("allow"), F.col("id").alias("pos"))
    urls = spark.range(100_000).select(F.concat(F.lit("https://x.org/r"), F.col("id").cast("string"), F.lit("/a")).alias("href"))
    got = {r.allowed: r["count"] for r in S.robots_filter(urls, rules, "me").groupBy("allowed").count().collect()}
    assert got == {False: 5000, True: 95_000}


def brute_clusters(v, eps):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - u @ u.T <= eps
    label = list(range(len(v)))
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(v))]
        changed, label = new != label, new
    return [x if label.count(x) > 1 else -1 for x in label]


VEC = "grp long, id long, embedding array<double>"


@pytest.mark.parametrize("eps,pivots,chunk", [(0.02, 16, 2000), (0.1, 4, 7), (0.3, 8, 25), (0.2, 0, 10), (1.2, 5, 20)])
def test_links_around_pivots_are_those_of_all_pairs(spark, eps, pivots, chunk):
    rng = np.random.default_rng(int(eps * 100))
    centres = rng.normal(size=(9, 5))
    v = np.concatenate([centres[rng.integers(0, 9, 150)] + rng.normal(size=(150, 5)) * rng.choice([0.02, 0.3], size=(150, 1)), rng.normal(size=(60, 5))])
    df = spark.createDataFrame([(1, k, [float(y) for y in x]) for k, x in enumerate(v)] + [(1, 900, None), (1, 901, [0.0] * 5)], VEC)
    got = {r.id: r.cluster for r in Q.eps_components(df, eps, few=10, pivots=pivots, chunk=chunk).collect()}
    assert [got[k] for k in range(len(v))] == brute_clusters(v, eps) and got[900] == got[901] == -1


def test_a_group_of_fifty_thousand_vectors(spark):
    n, rng = 50_000, np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 4
    v = centres[np.arange(n) % 20] + rng.normal(size=(n, 16)) * 0.05
    df = spark.createDataFrame([(1, k, x.tolist()) for k, x in enumerate(v)], VEC)
    got = Q.eps_components(df, 0.01).groupBy("cluster").count().collect()
    assert sorted((r.cluster, r["count"]) for r in got) == [(k, 2500) for k in range(20)]


def test_too_large_a_group_to_pair_is_an_error(spark):
    df = spark.range(30).select(F.lit(1).alias("grp"), F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert Q.pairwise_similarity(df, 30).count() == 435
    with pytest.raises(Exception, match="too many titles"):
        Q.pairwise_similarity(df, 29).count()


def test_cadences_by_outlet_are_least_squares(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for k, outlet in enumerate(["x", "y", None]):
        m = rng.integers(0, 1440, 500)
        y = 20 + k + 0.05 * m - 3e-5 * m**2 + rng.normal(0, 1, 500)
        want[outlet] = np.polynomial.polynomial.polyfit(m, y, 5)
        rows += [(outlet, int(a), float(b)) for a, b in zip(m, y, strict=True)]
    rows += [("one", 300, 12.0), ("one", 300, 14.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "outlet string, minutes_since_midnight int, time_diff double")
    got = {r.outlet: r for r in D.fit_cadences(df).collect()}
    at = np.arange(0, 1440, 30.0)
    for outlet, c in want.items():
        said = np.polynomial.polynomial.polyval(at, [got[outlet].intercept, *got[outlet].coefficients])
        assert np.allclose(said, np.polynomial.polynomial.polyval(at, c), atol=1e-6) and got[outlet].n == 500
    assert "none" not in got and D.fit_cadences(df.limit(0)).count() == 0
    last = spark.createDataFrame([("one", datetime(2024, 1, 1, 5)), ("new", datetime(2024, 1, 1, 5))], "outlet string, last_at timestamp_ntz")
    said = {r.outlet: (round(r.delay, 6), r.next_at) for r in D.next_scan_at(last, D.fit_cadences(df)).collect()}
    assert said == {"one": (13.0, datetime(2024, 1, 1, 5, 13)), "new": (30.0, datetime(2024, 1, 1, 5, 30))}


def plain_alignment(clean, changed):
    """Sentence lists aligned and merged one after another, with all pairs compared."""

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    def ratio(x, y):
        return 1 - distance(x, y) / max(len(x), len(y))

    left, right, rows = list(enumerate(clean)), list(enumerate(changed)), []
    for a, s in enumerate(clean):
        b = next((b for b, t in right if t == s), None)
        if b is not None:
            right.remove((b, s))
            left.remove((a, s))
            rows.append(["equal", a, b, s, s, 1.0])
    used = set()
    for b, t in right:
        best = max(((ratio(s, t), -a) for a, s in left), default=(0, 0))
        if best[0] > 0.6:
            used.add(-best[1])
            rows.append(["replaced", -best[1], b, clean[-best[1]], t, best[0]])
        else:
            rows.append(["inserted", None, b, None, t, None])
    matched = [r for r in rows if r[5] is not None]
    rows += [["deleted", a, None, s, None, None] for a, s in left if a not in used]

    def place(r):
        if r[2] is not None:
            return (r[2], 0, 0)
        before = [(m[1], m[2]) for m in matched if m[1] < r[1]]
        return (max(before)[1] if before else -1, 1, r[1])

    out, island = [], []
    for r in sorted(rows, key=place):
        if r[5] is None:
            island.append(r)
            continue
        c, h = (" ".join(x[k] for x in island if x[k]) for k in (3, 4))
        out += [["merged", None, None, c, h, ratio(c, h)]] if c and h and ratio(c, h) > r[5] else island
        out.append(r)
        island = []
    return {(r[0], r[3], r[4], None if r[5] is None else round(r[5], 9)) for r in out + island}


def test_alignment_with_merges_is_the_sequential_one(spark):
    rng = random.Random(9)
    words = "the river town boats came from sea market early late nobody asked stayed long water counted".split()
    pairs, want = [], {}
    for k in range(90):
        clean = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + "." for _ in range(rng.randint(1, 8))]
        changed = []
        for s in clean:
            how = rng.random()
            own = s.split()
            if how < 0.25 and len(own) > 3:
                changed += [" ".join(own[: len(own) // 2]) + ".", " ".join(own[len(own) // 2 :])]
            elif how < 0.5:
                changed.append(s.replace("e", "3", 2))
            elif how < 0.9:
                changed.append(s)
        pairs.append((k, "\n".join(clean), "\n".join(changed)))
        want[k] = plain_alignment(clean, changed)
    got = {}
    for r in R.align_revisions(spark.createDataFrame(pairs, "pair_id long, clean_text string, changed_text string")).collect():
        got.setdefault(r.pair_id, set()).add((r.kind, r.clean, r.changed, r.ratio and round(r.ratio, 9)))
    assert got == {k: v for k, v in want.items() if v}
    assert sum(x[0] == "merged" for v in want.values() for x in v) > 5


def test_long_texts_compare_few_sentences(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    clean = [" ".join(rng.choice(words) for _ in range(14)) + "." for _ in range(5000)]
    changed = [s[:20] + "#" + s[21:] for s in clean]
    df = spark.createDataFrame([(1, "\n".join(clean), "\n".join(changed))], "pair_id long, clean_text string, changed_text string")
    got = R.align_revisions(df).groupBy("kind").count().collect()
    assert [(r.kind, r["count"]) for r in got] == [("replaced", 5000)]
    l, r = (spark.createDataFrame([(1, k, s) for k, s in enumerate(x)], f"pair_id long, {a} int, {c} string") for x, a, c in ((clean, "a", "clean"), (changed, "b", "changed")))
    n = R.alike_by_grams(l, r).count()
    assert 5000 <= n < 1_250_000  # of 25 million; each word stands in some 23 sentences


def test_sentences_of_fitting_length_meet_once_whatever_the_blocks(spark):
    rng = random.Random(4)
    clean, changed = ([(k % 3 and 1, k, "x" * (rng.choice([0, 1, 2, 3, 5, 25, 27, 60, 100]) if k % 2 else rng.randint(1, 300))) for k in range(n)] for n in (400, 300))
    l, r = spark.createDataFrame(clean, "pair_id long, a int, clean string"), spark.createDataFrame(changed, "pair_id long, b int, changed string")
    want = sorted((p, a, b) for p, a, s in clean for q, b, t in changed if p == q and min(len(s), len(t)) > R.ALIGNED * max(len(s), len(t)))
    for block in (7, 500):
        assert sorted((x.pair_id, x.a, x.b) for x in R.of_fitting_length(l, r, R.ALIGNED, block).collect()) == want


def test_urls_shared_at_random_need_no_components(spark, monkeypatch):
    def contract(edges):
        raise AssertionError("components of what rounds decide")

    monkeypatch.setattr(S, "connected_components", contract)
    rng = random.Random(10)
    rows = [(k, [f"u{rng.randint(0, 300)}", f"s{k // 3}"]) for k in range(3000)]
    df = spark.createDataFrame(rows, "pos long, urls array<string>").withColumn("id", F.lit(None).cast("string"))
    assert sorted(r.pos for r in S.dedup_first_wins(df, walk_rows=300).collect()) == walk(rows)
