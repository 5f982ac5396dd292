"""What must not come back at size: shuffles of tokens, names that no longer look like addresses, entries that share a URL."""

import math
import random
import re
from collections import Counter

import pytest
from oracle import duck, rows_of
from pyspark.sql import functions as F

from newsfold.operators import pages as P
from newsfold.operators import quorum as Q
from newsfold.operators import revisions as V
from newsfold.operators import sections as S
from newsfold.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_power_of_addresses_that_the_source_names(spark):
    users = spark.createDataFrame([("10.0.0.1008", ["sysop"], None, None, True), ("10.0.0.1015", ["bot"], 1, None, True), ("1.2.3.4", ["bot"], None, None, False), ("::1", ["bot"], None, None, None)], "name string, groups array<string>, blockid long, invalid boolean, anonymous boolean")
    got = {r.name: r.power for r in V.power_levels(users, spark.createDataFrame([("10.0.0.1015",)], "ip string")).collect()}
    assert got == {"10.0.0.1008": 0, "10.0.0.1015": -10000, "1.2.3.4": 10, "::1": 0}


def test_tokens_are_labelled_without_a_shuffle(spark):
    rng = random.Random(3)

    def text():
        return rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(["a", "b", "B.", "été", "7"]) for _ in range(rng.randint(1, 12)))

    rows = [(i % 7, i, "equal" if i % 11 == 5 else "replaced", text(), text()) for i in range(200)]
    df = spark.createDataFrame(rows, "pair_id int, sent int, kind string, clean string, changed string")
    labelled, features = V.label_tokens(df), V.token_features(V.labelled_sentences(df))
    assert "Exchange" not in plan_of(labelled) and "Exchange" not in plan_of(features)

    def split(s):
        return s.replace(".", " .").split() if s is not None else None

    want, sentences = [], {}
    for pair, sent, kind, clean, changed in rows:
        if kind != "equal":
            left = Counter(split(clean) or ())
            for pos, t in enumerate(split(changed) or ()):
                want.append((pair, sent, pos, t, "N" if left[t] > 0 else "V"))
                left[t] -= 1
            want += [(pair, -sent - 1, pos, t, "N") for pos, t in enumerate(split(clean) or ())]
            sentences |= {(pair, sent): split(changed), (pair, -sent - 1): split(clean)}
    assert sorted(map(tuple, labelled.collect())) == sorted(want)
    # the features of sentences are those of their tokens
    own = sorted(features.collect(), key=lambda r: (r.pair_id, r.sent, r.pos))
    assert own == sorted(V.token_features(labelled).select(features.columns).collect(), key=lambda r: (r.pair_id, r.sent, r.pos))
    for r in own:
        s = sentences[r.pair_id, r.sent]
        assert (r.previous, r.next) == (s[r.pos - 1].lower() if r.pos else None, s[r.pos + 1].lower() if r.pos + 1 < len(s) else None)
    assert features.where(F.col("bos")).count() == sum(bool(s) for s in sentences.values())


def test_pairs_in_a_row_and_over_tasks_are_aligned_alike(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) + "."

    def changed(s):
        return "".join(c if rng.random() > p else rng.choice("xyz ") for c in s) if (p := rng.choice([0, 0, 0.03, 0.2])) else s

    rows = []
    for i in range(12):
        a = [sentence() for _ in range(rng.randint(0, 25))]
        b = [changed(s) for s in a if rng.random() > 0.15] + [sentence() for _ in range(rng.randint(0, 4))]
        rows.append((i if i else None, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(rows + [(90, None, "Only here."), (91, "Only there.", None)], "pair_id int, clean_text string, changed_text string")
    cols = ["pair_id", "kind", "clean", "changed", "ratio"]
    got = {n: sorted(map(repr, V.align_revisions(df, n).select(cols).collect())) for n in (0, 100, V.COMPARED)}
    assert got[0] == got[100] == got[V.COMPARED]
    assert {"equal", "replaced", "deleted", "inserted"} <= {eval(r.replace("Row(", "dict("))["kind"] for r in got[0]}


def test_pages_of_one_url_have_entries_of_their_own(spark, sf_dir, tmp_path):
    import os

    from oracle import duck, rows_of

    from newsfold.plans import catalog

    for t in os.listdir(sf_dir):
        if t != "pages.parquet":
            os.symlink(f"{sf_dir}/{t}", tmp_path / t)
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    again = p.assign(page_id=p.page_id + len(p))
    import pandas as pd

    pd.concat([p, again]).to_parquet(tmp_path / "pages.parquet")
    assert rows_of(catalog.queries()["discover"](spark, str(tmp_path))) == duck(catalog.oracle_sql()["discover"], str(tmp_path))


def test_ancestors_are_found_in_one_pass(spark):
    from newsfold.operators import sections as S

    levels = [2, 3, 5, 4, 3, 1, 6, 2, 6, 6, 1]
    text = "\n".join(f"{'#' * k} T{i}\nBody {i}." for i, k in enumerate(levels))
    docs = spark.createDataFrame([(1, "en", text), (2, "en", "# A\n## B\nb")], "doc_id int, language string, text string")
    tree = S.section_parents(S.split_sections(docs)).withColumn("summary", F.when(F.col("pos") % 3 > 0, F.concat(F.lit("S"), F.col("pos").cast("string"))))
    out = S.section_documents(tree)
    assert "Join" not in plan_of(out)
    rows = {(r.doc_id, r.pos): r for r in tree.collect()}
    for r in out.collect():
        path, parts, at = [], [], rows[r.doc_id, r.pos]
        parts, path, up = [at.body], [at.title], at.parent_pos
        while up is not None:
            a = rows[r.doc_id, up]
            path.insert(0, a.title)
            parts.insert(0, "\n\n".join(filter(None, [a.title, a.summary])))
            up = a.parent_pos
        assert (r.path, r.text) == (" > ".join(path), "\n\n".join(filter(None, parts)))


@pytest.mark.parametrize("chars", [50, 8_000_000])
def test_terms_are_sent_by_part_and_not_by_document(spark, monkeypatch, chars):
    monkeypatch.setattr(Q, "PART_CHARS", chars, raising=False)
    rng = random.Random(chars)
    words = ["The", "x", "árbol", "Wort", "a_1", "99", "zz", "𝒜b"]
    rows = [(None if i == 7 else i - 2**60, rng.choice([None, "", "the"]) if i % 9 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(80)]
    rows.append((rows[1][0], "Wort zz zz"))  # an id that comes twice
    df = Q.tfidf_top_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan_of(df))) == {"__part", "term"}
    tf: dict = {}
    for i, text in rows:
        w = [x for x in re.findall(r"\w{2,}", (text or "").lower()) if x not in Q.STOP_WORDS]
        if w:
            tf.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    n = Counter(t for c in tf.values() for t in c)
    want = set()
    for i, c in tf.items():
        x = {t: k * (math.log((1 + len(rows)) / (1 + n[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        best = sorted((-round(v / norm, 9), t) for t, v in x.items())[:10]
        want |= {(i, t, -w, k + 1) for k, (w, t) in enumerate(best)}
    assert {tuple(r) for r in df.collect()} == want


def test_likeliest_language_is_that_of_the_counted_trigrams(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 3000, raising=False)
    rng = random.Random(13)
    alphabets = {"xx": "abc dé", "yy": "cde fß", "zz": "漢字𝒜a 𝒜"}
    rows = [(i, lang, "".join(rng.choices(alphabets[lang], k=rng.randint(0, 60)))) for i, lang in enumerate(rng.choices(sorted(alphabets), k=300))]
    rows += [(1000, "xx", None), (1001, None, "abc"), (1002, "yy", ""), (1003, None, "qqq www"), (1004, None, None), (1005, None, "b" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, language string, text string")
    plain = {r.doc_id: r.t for r in docs.select("doc_id", P.letters(F.col("text")).alias("t")).collect()}
    grams = {i: Counter(t[k : k + 3] for k in range(len(t or "") - 2)) for i, t in plain.items()}
    top = {}
    for lang in alphabets:
        n = sum((grams[i] for i, own, _ in rows if own == lang), Counter())
        top[lang] = {g: math.log(k / n.total()) for g, k in sorted(n.items(), key=lambda x: (-x[1], x[0]))[: P.PROFILE]}
    known = set().union(*top.values())
    want = {}
    for i, c in grams.items():
        own = {g: k for g, k in c.items() if g in known}
        score = {lang: round(sum(k * top[lang].get(g, math.log(P.UNSEEN)) for g, k in own.items()), 6) for lang in top}
        want[i] = max(score, key=lambda lang: (score[lang], lang)) if own else None
    profiles = P.language_profiles(docs)
    assert {(r.language, r.gram) for r in profiles.collect()} == {(lang, g) for lang in top for g in top[lang]}
    got = docs.select("doc_id", P.likeliest(F.col("text"), profiles).alias("detected"))
    assert {r.doc_id: r.detected for r in got.collect()} == want == {r.doc_id: r.detected for r in P.detect_language(docs, profiles).collect()}
    nobody = docs.where("false").select("doc_id", "language", "text")
    assert docs.select(P.likeliest(F.col("text"), P.language_profiles(nobody)).alias("x")).where("x is not null").count() == 0


def test_pages_are_read_once_for_their_language(spark, sf_dir):
    docs = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, language string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = plan_of(P.extract_pages(pages, profiles=P.language_profiles(docs)))
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan


def test_sections_are_rolled_up_without_writing(spark):
    rng = random.Random(15)
    texts = ["\n".join(f"{'#' * rng.randint(1, 6)} h{k}\n{rng.choice(['', 'One. Two.', '<skip>.'])}" for k in range(rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, language string, text string")
    parts = S.split_sections(docs)
    assert re.search(r"\[doc_id#\d+L, language#\d+\], false, \[pos#", plan_of(parts))  # no row carries its document
    tree = S.section_parents(parts)
    rows = {(r.doc_id, r.pos): r for r in tree.collect()}

    def said(doc, pos):
        r = rows[doc, pos]
        kids = [s for s in (said(*k) for k in sorted(rows) if k[0] == doc and rows[k].parent_pos == pos) if s]
        text = "\n\n".join([r.title, *([r.body] if r.body else []), *(f"<summary>{k}</summary>" for k in kids)])
        return "" if "<skip>" in text else text

    def same(given):
        assert all(isinstance(t, str) for t in given)
        return given

    built_in = [lambda t: t]
    for fn in (*built_in, S.summariser(same)):
        got = S.roll_up(tree, fn)
        assert "FileScan" not in plan_of(got) and (fn not in built_in or plan_of(got).count("Exchange") == 1)
        assert got.columns == [*tree.columns, "summary"]
        assert {(r.doc_id, r.pos, r.summary) for r in got.collect()} == {(*k, said(*k)) for k in rows}


@pytest.mark.parametrize("name", ["html_to_markdown", "extract_pages"])
def test_references_that_a_heading_cuts_are_read_as_in_sql(spark, sf_dir, tmp_path, name):
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(60).toPandas() for t in ("pages", "documents"))
    cut = ["&quot", "&quo", "&quot;", "&amp", "&am", "&", "&amp;quot", "&quot&quot;"]
    for tag in ("h1", "title"):
        pages["html"] = [h.replace(f"</{tag}>", f" token = {cut[i % len(cut)]}</{tag}>") for i, h in enumerate(pages["html"])]
    pages.to_parquet(tmp_path / "pages.parquet")
    docs.to_parquet(tmp_path / "documents.parquet")
    assert rows_of(catalog.queries()[name](spark, str(tmp_path))) == duck(catalog.oracle_sql()[name], str(tmp_path))


def test_token_features_are_counted_by_document_in_one_stage(spark, sf_dir):
    plan = plan_of(catalog.queries()["token_features"](spark, sf_dir))
    # documents are dealt once; labels, which aren't counted, are not looked for
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "EvalPython" not in plan
    odd = ["abc", "abc\n", "", "Abc", "été", "ÉTÉ", "x2", "٣", "a_b", "ß", "ªb", "á", ".", "12", None]
    rows = spark.createDataFrame([(1, i, odd[i], "N") for i in range(len(odd))], "pair_id int, pos int, token string, label string")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "\\p{Lu}", "X"), "\\p{Ll}", "x"), "\\p{Nd}", "d")
    f = V.token_features(rows, ("pair_id",))
    for c, want in (("shape", shape), ("is_alpha", F.col("token").rlike("^\\p{L}+$")), ("is_digit", F.col("token").rlike("^\\p{Nd}+$"))):
        assert f.where(~F.col(c).eqNullSafe(want)).count() == 0, c


def test_token_classifier_holds_distinct_rows_and_learns_as_from_all(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    rng = random.Random(11)
    words = ["a", "bee", "XX", "Été", "7", "c1", "."]
    rows = [(i, 0, p, rng.choice(words)) for i in range(400) for p in range(rng.randint(1, 5))]
    rows = [(*r, "V" if (r[3] in ("XX", "7")) ^ (rng.random() < 0.1) else "N") for r in rows]
    f = V.token_features(spark.createDataFrame(rows, "pair_id long, sent int, pos int, token string, label string")).cache()
    model = V.fit_token_classifier(f)
    seen = V.predicted_in_training(model)
    assert dict(seen.dtypes)["n"] == "bigint" and seen.count() == f.select("label", *V.FEATURES).distinct().count() < f.count()
    # equal rows, counted, give the model of all rows, but that a variance is divided by n less the mean count instead of n - 1
    plain = Pipeline(stages=[*model.stages[:2], LogisticRegression(labelCol="y", featuresCol="features", maxIter=20, regParam=0.001)]).fit(f.fillna("", ["previous", "next"]))
    assert model.stages[-1].coefficients.toArray() == pytest.approx(plain.stages[-1].coefficients.toArray(), abs=0.02)
    alike = V.predict_tokens(model, f).groupBy("label", "predicted").count().collect()
    assert sorted(alike) == sorted(V.predict_tokens(plain, f).groupBy("label", "predicted").count().collect())
    assert sorted(alike) == sorted(seen.groupBy("label", "predicted").agg(F.sum("n")).collect())
    report = V.classification_report(seen, n="n")
    assert report.schema == V.classification_report(V.predict_tokens(model, f)).schema
    assert sorted(report.collect()) == sorted(V.classification_report(V.predict_tokens(model, f)).collect())
