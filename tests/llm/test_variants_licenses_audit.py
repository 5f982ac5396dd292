"""Spelling variants, licence scans and the filter audit: SQL, brute force, and odd inputs."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck, rows_of
from pyspark.sql import functions as F

from newsfold.llm import filter_audit, license_scan, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    long = "abcdefgh permission granted Xyz " * 5000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", None, 1), (4, "Under the MIT License. $", "en", "s", 1), (4, "Under the MIT License. $", "en", "s", 1), (4, "another text", "en", "t", 1), (9, "another text", "en", "t", 1), (None, "Under the MIT License. $", None, "s", 1), (None, None, None, None, None), (6, " \n\t ", "en", "s", 1), (7, "é漢字 \x00 \x1c STRASSEß straßess", "xx", "s", 1)]
    clashes = ("word", "n", "part", "mask", "h", "start", "__short", "__LONG", "id", "labels", "first")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in clashes})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, ratio=10):
    form, rows = {}, {}
    for w, n in words.items():
        own = sorted((-m, v) for v, m in words.items() if near(v, w))
        best = own[0] if own and -own[0][0] >= ratio * n else (None, None)
        form[w] = best[1]
        rows[w] = (n, len(own), best[1], best[0] and -best[0])
    out = set()
    for w, (n, k, f, m) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, f, root, n, k, m))
    return out


def test_op11_is_the_sql(spark, sf_dir):
    assert rows_of(spelling.op11(spark, sf_dir)) == duck(spelling.OP11_SQL, sf_dir)


@pytest.mark.parametrize("seed", range(3))
def test_variants_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): int(10 ** rng.uniform(0.3, 6)) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("rest", F.lit(1))
    assert {tuple(r) for r in spelling.variants(df).collect()} == brute_variants(words)
    assert {tuple(r) for r in spelling.variants(df, 2).collect()} == brute_variants(words, 2)


def test_a_group_holds_an_alphabet_at_most(spark):
    words = [(f"aa{c}aa", 2) for c in "abcdefghijklmnopqrstuvwxyz"] + [("aaaa", 100)]
    sizes = [r["count"] for r in spelling.rotations(spark.createDataFrame(words, "word string, n long")).groupBy("rest").count().collect()]
    assert max(sizes) == 27
    got = {r.word: r.n_near for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaa"] == 26 and got["aabaa"] == 26


def test_long_ways_up_end_at_the_root(spark):
    words = [("z" * 20 + "a" * k, 2 * 4**k) for k in range(14)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(words, "word string, n long"), 4).collect()}
    assert set(got.values()) == {words[-1][0]}


def brute_words(rows, every):
    import zlib

    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {(w, k) for w, k in n.items() if len(w) >= 7 and k >= 2}


@pytest.mark.parametrize("every", [0, 1, 3, 31])
def test_word_counts_by_brute_force(spark, odd, empty, sf_dir, every, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    given_ = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in spelling.count_words(given_, every=every).collect()} == brute_words(rows, every)
    assert spelling.count_words(odd, every=every).columns == ["word", "n"] and spelling.variants(spelling.count_words(empty)).count() == 0


# licence scans


def test_op12_is_the_sql(spark, sf_dir):
    assert rows_of(license_scan.op12(spark, sf_dir)) == duck(license_scan.OP12_SQL, sf_dir)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc x".split()), max_size=40))
def test_base_places_by_brute_force(words):
    index = license_scan.Index(license_scan.templates(), {})
    want = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    assert sorted(index.base_places([w.encode() for w in words])) == sorted(want)


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from(list("aZ0 /:`{~\x7f\x80é漢-_")), max_size=40))
def test_words_of_any_text(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert [w.decode() for w in license_scan.words(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


@pytest.mark.parametrize("label,notice,keys", license_scan.TEMPLATES)
def test_every_notice_is_found_within_other_text(label, notice, keys):
    index = license_scan.Index(license_scan.templates(), {w: 9 for w in [b"the", b"of", b"and", b"or", b"to"]})
    text = license_scan.words("some words before " * 30 + notice + " other words behind" * 30)
    assert label in {index.templates[k].label for k in index.found(text)}


def test_notices_with_added_words_are_found_and_loose_words_are_not():
    index = license_scan.Index(license_scan.templates(), {w: 9 for w in [b"the", b"of", b"and", b"or", b"to"]})

    def found(text):
        return {index.templates[k].label for k in index.found(license_scan.words(text))}

    mit = license_scan.TEMPLATES[0][1]
    assert "mit" in found(mit.replace("the software without restriction", "the above named software without restriction"))
    assert found(mit.replace("free of charge", "for money")) == set()  # a key phrase is missing
    assert found(" ".join(sorted(mit.split()))) == set()
    assert found("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") == {"gpl-3"}
    assert found("A gnu is a general animal. The public needs no license for version 3 of it.") == set()
    assert found("Licensed under the GNU General Public License, version 3.") == {"gpl-3"}
    assert found(" ".join(n for _, n, _ in license_scan.TEMPLATES)) >= {"mit", "bsd", "isc", "zlib", "mpl-2", "epl-2", "unlicense", "cc0"}


def test_licenses_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_scan.scan(odd).collect()}
    assert {(1, 0, 0, None, None, "", "", 0.0), (4, 4, 1, 0, 0, "mit", "mit", 1.0), (None, 4, 1, 0, 0, "mit", "mit", 1.0), (3, 20000, 0, None, None, "", "", 0.0)} <= got
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


# filter audit


def test_op13_is_the_sql(spark, sf_dir):
    assert rows_of(filter_audit.op13(spark, sf_dir)) == duck(filter_audit.OP13_SQL, sf_dir)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=40))
def test_tries_hold_the_least_ids(rows):
    trie, want = filter_audit.Trie(), {}
    for text, i in rows:
        trie.insert(text, i, text)
        want[text] = min(i, want.get(text, i))
    assert {tag: i for i, tag in trie.entries()} == want and len(list(trie.entries())) == len(want)


def test_a_trie_of_long_shared_prefixes_is_deep_without_recursion():
    trie = filter_audit.Trie()
    for k in range(3000):
        trie.insert(b"a" * k, k, k)
    assert len(list(trie.entries())) == 3000


def brute_audit(rows, labels):
    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)), strict=True) if x}

    rows = [(i, t or "", p or "") for i, t, p in rows]
    failed = [(p, fails(i, t), i) for i, t, p in rows]
    out = {}
    for part in {p for _, _, p in rows}:
        own = [(f, i) for p, f, i in failed if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(removed)
                marked = [sum(bool(labels.get(i, (0, 0))[m]) for _, i in removed) for m in (0, 1)]
                out[part, order, k + 1] = [len(left), len(removed), sum(f in x[0] for x in own) - len(removed), sum(x[0] == {f} for x in own), *marked]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("trie_bytes", [32 << 20, 2000])
def test_audit_by_brute_force(spark, odd, empty, trie_bytes, monkeypatch):
    monkeypatch.setattr(filter_audit, "SENT", 3)
    monkeypatch.setattr(filter_audit, "LONG", 12)
    rng = random.Random(5)
    more = [(100 + k, "the same beginning " + rng.choice(["", "A", "B $", "word " * rng.randint(45, 55), f"w{k} " * 60]), rng.choice(["s", "u", None])) for k in range(150)]
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()] + more
    docs = spark.createDataFrame([(i, t, None, p, None) for i, t, p in rows], DOCS).withColumns({c: F.lit(1) for c in ("part", "mask", "h", "prefix", "deal", "first", "quality")})
    labels = spark.createDataFrame([(i, i % 3 == 0, i % 5 == 0) for i in range(4, 200)] + [(7, True, True), (None, True, True)], "doc_id long, quality boolean, toxic boolean").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), F.lit(1).alias("first"))
    marks = {i: (i % 3 == 0 or i == 7, i % 5 == 0 or i == 7) for i in range(4, 200)}
    assert {tuple(r) for r in filter_audit.audit(docs, labels, trie_bytes).collect()} == brute_audit(rows, marks)
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
