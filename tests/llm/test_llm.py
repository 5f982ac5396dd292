"""The corpus operators against brute force, the libraries, exact round trips and held-out labels; and their odd inputs."""

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from newsfold.functions.graph import connected_components
from newsfold.llm import byte_bpe, exact_dedup, fuse, html_text, packing, quality_model, quality_rules, queries, sharding, simhash, substring_dedup, token_counts

PIECES, RANKS, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on the mat and " * 4000
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", None, 1), (4, "Tie one two.", "en", "s", 1), (5, "tIE one two.", "en", "s", 1), (None, "no id", None, "s", 1), (5, "tIE one two.", "en", "s", 1), (6, " \n\t ", "en", "s", 1), (7, "é漢字 <|endoftext|> <s> \x1c x y", "xx", "s", 1)]
TEXTS = st.text(st.sampled_from(list("abeT .,'\n\t<|s>é漢▁1  ")), max_size=60)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("class", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("batch", F.lit(9)).withColumn("kept", F.lit(None).cast("int")).withColumn("Size", F.lit(3)).withColumn("__id", F.lit(1)).withColumn("__Digest", F.lit(2)).withColumn("__gone", F.lit(1)).withColumn("__spans", F.lit(1)).withColumn("__out", F.lit(1)).withColumn("at", F.lit(1)).withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# exact dedup


@settings(deadline=None, max_examples=40)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_fuse_has_all_keys(keys):
    k = np.array(sorted(keys), np.uint64)
    assert fuse.contains(fuse.build(k), k).all()


def test_fuse_is_small_and_selective():
    rng = np.random.default_rng(0)
    k = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    blob = fuse.build(k)
    assert len(blob) * 8 < 10 * len(k) and fuse.contains(blob, rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.006


def test_op1_is_the_sql(spark, sf_dir):
    assert rows_of(exact_dedup.op1(spark, sf_dir)) == duck(exact_dedup.OP1_SQL, sf_dir)


def test_exact_dedup_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (4, 5, 3, False), (5, 5, 3, True), (None, None, 1, True)} <= got
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(odd).where("doc_id is not null").collect()) == [2, 3, 5, 5, 6, 7]


def test_bytes_tell_equal_digests_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "B")], "doc_id long, text string")

    def weak(c):
        return F.unhex(F.lit("00"))

    def rows(ids):
        return exact_dedup.digests(docs.where(F.col("doc_id").isin(ids)), F.lit(0), weak)

    for new, want in ((2, (1, 2)), (3, (2, 3))):
        old, got = exact_dedup.merge_batch(exact_dedup.build_snapshot(rows([want[0]])), rows([new]), docs, weak)
        same = lower("ab"[want[0] - 1]) == lower("ab B"[new])
        assert old.first().keep_id == (new if want == (2, 3) else 1) and got.first().group_size == (2 if want == (2, 3) else 1), same


# token counts


def test_token_counts_are_the_librarys(docs, odd, empty):
    sp = token_counts.processor(PIECES)
    for df in (docs, odd):
        for r in token_counts.count_tokens(df, PIECES).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            assert (r.n_tokens, r.n_bytes) == (len(sp.encode(r.text or "")), len((r.text or "").encode())) and r.over_limit == (r.n_tokens > 4096)
    assert token_counts.count_tokens(odd, PIECES).count() == len(ODD) and token_counts.count_tokens(empty, PIECES).count() == 0


COUNTER = token_counts.Counter(PIECES, token_counts.whole_tokens(PIECES))


@settings(deadline=None, max_examples=300)
@given(TEXTS)
def test_token_counts_of_any_text(text):
    assert COUNTER.counts([text]) == [len(COUNTER.sp.encode(text))]


# simhash


def brute_simhash(rows):
    import xxhash

    fps = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, "%016x" % fps[i], find(i)) for i in fps}


def test_op3_is_brute_force(spark, sf_dir, docs, odd, empty):
    assert {tuple(r) for r in simhash.op3(spark, sf_dir).collect()} == brute_simhash([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (6, 1), (4, 4), (5, 4)} <= got and simhash.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in simhash.drop_near_copies(odd).where("doc_id is not null").collect()) == [1, 3, 4, 7]


@pytest.mark.parametrize("parts,block", [([(list(range(0, 20)), 1), (list(range(20, 40)), 1), (list(range(40, 64)), 0)], 8192), ([(list(range(i, 64, 5)), 0) for i in range(5)], 40), (None, 8192)])
def test_links_lose_no_pair(spark, parts, block):
    rng = np.random.default_rng(3)

    def flip(x, k):
        for _ in range(k):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
        return x

    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    fp = np.unique(np.concatenate([base, *[flip(base, 3) for _ in range(8)], flip(np.full(300, 7, np.uint64), 2)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = simhash.links(df, 4, parts, block)
    root = dict(connected_components(links).collect())
    want = {int(x): int(x) for x in fp.view(np.int64)}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, x in enumerate(fp):
        for y in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ x) <= 4]:
            a, b = find(int(x.view(np.int64))), find(int(y.view(np.int64)))
            want[max(a, b)] = min(a, b)
    groups = defaultdict(set), defaultdict(set)
    for x in want:
        groups[0][find(x)].add(x)
        groups[1][root.get(x, x)].add(x)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_a_forest_has_a_link_less_than_rows():
    fp = np.unique(np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))
    a, b = simhash._forest(fp, 4)
    assert len(a) == len(b) == len(fp) - 1 and set(b) | {0} == set(range(len(fp)))


# quality model


def test_held_out_accuracy(spark, sf_dir):
    got = quality_model.op4(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    own = got[got.held_out]
    assert (own.predicted == own.quality).mean() > 0.9 and (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


def plain_features(t):
    """The features of a text, one by one in plain Python."""
    words, lines, n = [w for w in re.split("[ \t-\r]+", t) if w], [x for x in t.split("\n") if x], len(t)

    def share(chars, of):
        return sum(c in chars for c in t) / of if of else 0.0

    return [
        np.log1p(len(words)), len(set(words)) / len(words) if words else 1.0, sum(c not in " \t\n\x0b\x0c\r" for c in t) / len(words) if words else 0.0, share("#*$%&<>@^~=+_{}[]\\", n), share("!", n),
        sum(unicodedata.category(c) == "Lu" for c in t) / n if n else 0.0, share("0123456789", n), share(".,;:?", len(words)), share("|", len(words)), len(lines) / len(words) if words else 0.0, (len(lines) - len(set(lines))) / len(lines) if lines else 0.0,
    ]


def test_op4_is_brute_force(spark, sf_dir, docs):
    x = {r.doc_id: plain_features(r.text or "") for r in docs.collect()}
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    learnt = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    m = quality_model.fit(np.array([x[i] for i in learnt]), np.array([labels[i] for i in learnt]))
    for r in quality_model.op4(spark, sf_dir).collect():
        own, total = x[r.doc_id], m.start
        for k, (edges, table) in enumerate(zip(m.edges, m.tables, strict=True)):
            total += table[sum(own[k] >= e for e in edges)]
        for i, j, table in m.pairs:
            total += table[sum(own[i] >= e for e in m.pair_edges[i]), sum(own[j] >= e for e in m.pair_edges[j])]
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(odd, labels).count() == len(ODD) and quality_model.classify(empty, labels).count() == 0
    assert {r.score for r in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}
    model = quality_model.fit(np.array([[float(i % 2)] * len(quality_model.FEATURES) for i in range(200)]), np.array([i % 2 for i in range(200)], float))
    assert model.score(np.ones((1, len(quality_model.FEATURES))))[0] > 0.9 > 0.1 > model.score(np.zeros((1, len(quality_model.FEATURES))))[0]


# byte BPE


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_op5_is_the_library_and_its_inverse(spark, odd, empty, sf_dir, docs, encoding):
    for df in (docs, odd):
        for r in byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            ids = np.array(encoding.encode_ordinary(r.text or ""), "<u4")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN).where("size(ids) = 0").count() == 2


CODEC = byte_bpe.Codec(byte_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@settings(deadline=None, max_examples=200)
@given(st.text(st.sampled_from(list("thenrsaio")), min_size=20, max_size=600) | TEXTS)
def test_trees_of_any_text(text):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
    ids = CODEC.encode(text).tolist()
    assert ids == enc.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


# quality rules


def test_op6_is_the_sql(spark, sf_dir):
    assert rows_of(quality_rules.op6(spark, sf_dir)) == duck(quality_rules.OP6_SQL, sf_dir)


def test_rules_of_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in quality_rules.measured(odd).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[3].n_words == 28000 == got[3].n_repeat_words and got[3].base_failed and got[6].n_words == 0
    assert quality_rules.measured(empty).count() == 0 and quality_rules.clean(odd).columns == odd.columns
    body = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, body + "\nAll rights reserved.\na | b | c | d"), (2, "!! ".join(["Buy"] * 5) + "\n" + " ".join(f"w{i}$$$" for i in range(60)))], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in quality_rules.clean(df).collect()] == [(1, body)]


# html


def test_html_of_made_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home, and more.</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies, as everyone does. Accept?</div><main><article><h1>Head &amp; shoulders</h1><p>First <b>bold</b> text, with  commas.<br>next<p>Second
    paragraph; it goes on. And on.</p><form><p>Sign up, please.</p></form><ul><li>Item one.</li><li>Item two.</li></ul></article><aside>Related, and so on.</aside>
    <div id="comments"><p>I disagree, strongly. Very much so, indeed.</p></div></main><script>var x = "<p>no</p>";</script><footer>&copy; 2024, all.</footer></body></html>"""
    assert html_text.main_text(page) == "Head & shoulders First bold text, with commas. next Second paragraph; it goes on. And on. Item one. Item two."
    assert html_text.main_text("<div id=menu><a>x</a></div><div><h2>Hi there</h2><p>Some text, long enough. Yes.</p><p>More of it, too.</p></div><div class=sidebar>no, no.</div>") == "Hi there Some text, long enough. Yes. More of it, too."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<p>a < b &lt; c") == "a < b < c"


def test_html_of_the_pages(spark, sf_dir):
    import html

    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.op7(spark, sf_dir).collect():
        art = re.search("<article>(.*?)</article>", src[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", art))).split()) and r.n_chars == len(r.text)
    none = spark.createDataFrame([(1, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert {(r.page_id, r.n_chars) for r in html_text.extract(none).collect()} == {(1, 0), (None, 1)} and html_text.extract(none.limit(0)).count() == 0


def test_silent_elements_hide_only_themselves():
    text = "<p>First text, long enough. Yes.</p>%s<p>More of it, too. And on.</p>"
    want = "First text, long enough. Yes. More of it, too. And on."
    for odd in ("<select><option>A<option>B</select>", "<datalist><option>A<option>B</datalist>", "<select><optgroup label=x><option>A<optgroup label=y><option>B</select>", "<noscript><div>no, no.</div></noscript>", "<noscript>no</div></article></noscript>", "<div><button>no</div>", "<button>no", "<noscript>no", "<iframe src=x>", "<object><object>no</object>", "<div><noscript><iframe src=x></noscript></div>", "<select><option>A</select>"):
        assert html_text.main_text("<body><div><article><div>" + text % odd + "</div></article></div>") == want, odd
    assert html_text.main_text("<article>" + text % "<button>A<p>no</p><button>B</button>" + "</article>") == "First text, long enough. Yes. no More of it, too. And on."


def test_odd_declarations_and_references_lose_nothing():
    for odd in ("<![ foo ]>", "<![foo[x]]>", "<![>", "<![if IE>", "<![CDATA[ no >", "<![endif]>", "<!foo>", "<!>", "</ >", "<?x>"):
        assert html_text.main_text(f"<p>First text, here.</p>{odd}<p>Second text, here.</p>") == "First text, here. Second text, here.", odd
    for odd, sign in ((f"&#{'9' * 5000};", "\ufffd"), (f"&#{'0' * 5000}65;", "A"), (f"&#{'0' * 30};", "\ufffd")):
        assert html_text.main_text(f"<p>First text, {odd}.</p><p>Second text, here.</p>") == f"First text, {sign}. Second text, here."


def test_text_beside_the_main_container_stays():
    def told(n):
        return " ".join(f"Word{i} of it, and so on." for i in range(n))

    end = "<footer>No, no. No.</footer>"
    lead, body = told(7), told(13)
    assert html_text.main_text(f"<body><div id=content><h1>T</h1><div class=lead>{lead}</div><div class=body>{body}</div></div>{end}") == f"T {lead} {body}"
    assert html_text.main_text(f"<body><main><article><p>{body}</p></article><section><p>{lead}</p></section></main>{end}") == f"{body} {lead}"
    assert html_text.main_text(f"<body><div><p>{lead}</p><ul><li>{body}</li></ul><p>{lead}</p></div>{end}") == f"{lead} {body} {lead}"
    assert html_text.main_text(f"<body><article><p>{body}</p></article><article><p>{lead}</p><ul><li>One</li></ul></article>{end}") == f"{body} {lead} One"
    for name in ("has-sidebar", "with-nav", "no-header", "layout-with-sidebar", "page sidebar-right"):
        page = f"<body><div class='{name}'><div class=text><p>{body}</p></div><div class=sidebar>Other things, here. Or there.</div></div>%s{end}"
        assert html_text.main_text(page % "") == body, name
        assert html_text.main_text(page % "<div>Call us. Now.</div>").startswith(body), name
    assert html_text.main_text(f"<body><div class=widget>{body}</div><div class=widget>{body}</div>{end}") == f"{body} {body}"
    assert html_text.main_text(f"<body><form id=aspnet><div><p>{body}</p></div><div class=comments><p>{lead}</p></div></form>{end}") == body


def test_links_headers_and_comments():
    body = "".join(f"<p>The {k} body has long text, with commas and such. It goes on and on, as text does.</p>" for k in range(6))
    want = " ".join(re.findall("<p>(.*?)</p>", body))
    for page in (
        "<div id=search-results-page>%s</div>", "<article>%s<section><h3>Comments (2)</h3><div><b>Bob</b> said: nice one, thanks. Really.</div><div>I don't agree, at all. Sorry.</div></section></article>",
        "<article><div><a href=/>Home</a> <a href=/a>About</a></div>%s<div><a href=x>Buy now Win big</a></div></article>", "<article>%s<h2>Related articles</h2><ul><li>One, of many. So it is.</ul></article>",
        "<body><ul><li><a href=/>Home, sweet home.</a><li><a href=/b>All, and more.</a></ul><div>%s</div></body>", "<article>%s<a href=/c><div>A card, that links. Go on.</div></a></article>",
    ):
        assert html_text.main_text(page % body) == want, page
    for name in ("entry-header", "post-header", "article_header"):
        assert html_text.main_text(f"<article><div class={name}><h1>Head line</h1></div>{body}</article>") == f"Head line {want}"
    assert html_text.main_text(f"<article><h1><a href=/>Head line</a></h1>{body}<p>So says <a href=x>the paper, at length.</a> Yes.</p></article>") == f"Head line {want} So says the paper, at length. Yes."
    assert html_text.main_text(f"<article>{body}<h2>Comments</h2><p>I disagree, strongly. Yes.</p><h2>Results</h2><p>It went well, in all. Yes.</p></article>") == f"{want} Results It went well, in all. Yes."


def test_depth_costs_nothing():
    import time

    began = time.process_time()
    for page, want in (("<div><p>a, b.</p>" * 4000, "a, b. " * 4000), ("<b class=x>" * 4000 + "a, b." + "</i>" * 4000, "a, b."), ("<ul><li>a, b. <a>" * 3000 + "</p>" * 3000, "a, b. " * 3000), ("<div class=ad>" * 3000 + "x</div>" + "<p>a, b.</p>" * 3000, "")):
        assert html_text.main_text(page) == want.strip() or not want, page[:40]
    assert time.process_time() - began < 8


def test_article_text_stays_and_unnamed_furniture_goes():
    text = "Police said on Monday, after a long night, that the road is open. Traffic goes on, slowly."
    p = f"<p>{text}</p>"

    def told(page):
        return html_text.main_text(page)

    for heading in ("Advertisement", "Read more", "Newsletter", "Replies", "Related"):
        assert told(f"<article>{p}<h2>{heading}</h2>{p}</article>") == f"{text} {text}", heading
    assert told(f"<article>{p * 2}<p class=alert>Police warned, again, of ice.</p></article>") == f"{text} {text} Police warned, again, of ice."
    assert told(f"<article><div class=promotion-history>{p * 2}</div></article>") == f"{text} {text}"
    assert told(f"<article>{p * 2}<p><a href=x>The full report, published on Monday, is here.</a></p></article>") == f"{text} {text} The full report, published on Monday, is here."
    four = " ".join([text] * 4)
    assert told(f"<body><div>We use cookies, to improve your stay. Fine?</div><article>{p * 4}</article></body>") == four
    assert told(f"<body><div class=top>Home, News, Sport</div><div class=story>{p * 4}</div><div class=bottom>Copyright 2024, all rights reserved.</div></body>") == four
    for odd in (f"<div class='discussion-thread'>{p}</div>", "<div class=adsbygoogle>Buy, now. Win.</div>", "<h3>12 Meinungen</h3><p>Nein, so nicht. Nie.</p>", "<h3>Kommentare (3)</h3><p>Doch, so schon. Immer.</p>"):
        assert told(f"<article>{p * 4}{odd}</article>") == four, odd


@pytest.mark.parametrize("page", ["<div><h2>Comments</h2><p>a, b.</p>", "<svg></g></x>", "<svg></math></canvas>", "<div><h2>Newsletter</h2><li>a, b.</li>", "<center>x", "<object></div>", "<div><svg></div>"])
def test_nesting_costs_its_length(page):
    import time

    spent = []
    for n in (2000, 8000):
        began = time.process_time()
        html_text.main_text(page * n)
        spent.append(time.process_time() - began)
    assert spent[1] < 10 * spent[0] + 0.2, spent  # four times the text


def made_page(rng):
    """A page of random parts and, beside it, its main text: what is put together here isn't read back by any parser."""

    def told(n):
        return " ".join(" ".join(f"w{rng.integers(1000)}" for _ in range(rng.integers(5, 12))).capitalize() + ("," if rng.random() < 0.5 else "") + " and so it goes." for _ in range(n))

    main, parts = [], []
    for _ in range(rng.integers(4, 12)):
        t = told(rng.integers(1, 4))
        kind = rng.integers(6)
        if kind == 0:
            h = f"Part {rng.integers(100)} & more"
            main.append(h)
            parts.append(f"<h2>{h.replace('&', '&amp;')}</h2>")
        main.append(t)
        half = len(t) // 2 - len(t[: len(t) // 2].split(" ")[-1])
        parts.append([f"<p>{t}</p>", f"<p>{t}", f"<div class='text body'>{t}</div>", f"<p>{t[:half]}<b>{t[half:]}</b></p>\n", f"<blockquote><p>{t}</blockquote>", f"<p id=p{len(parts)}>{t[:half].strip()}<br>\n  {t[half:]}</p><!-- <p>no</p> -->"][kind])
        if rng.random() < 0.5:
            parts.append(["<script>var a = '<p>no, no. No.</p>';</script>", "<form><label>Mail, please.</label><input><select><option>a<option>b</select></form>", f"<aside><p>{told(1)}</p></aside>", f"<div class='ad-box'>{told(1)}</div>", f"<ul><li><a href=/x>{told(1)}</a><li><a href=/y>Next</a></ul>", "<style>p{}</style>", f"<div class=newsletter>{told(1)}</div>"][rng.integers(7)])
    head = "<header><a href=/>Home, and more.</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class=cookie-notice>We use cookies, as all do. Fine?</div>"
    tail = ["", f"<section id=comments><p>{told(1)}</p><p>{told(1)}</p></section>", f"<div><h3>3 comments</h3><p>{told(1)}</p></div>"][rng.integers(3)]
    around = ["<article>%s</article>", "<div class='layout has-sidebar'><div id=content>%s</div></div>", "<main><div><div>%s</div></div></main>"][rng.integers(3)]
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{head}{around % ''.join(parts)}{tail}<div class=sidebar>{told(1)}</div><footer>&copy; {told(1)}</footer></body></html>", " ".join(main)


def test_html_of_random_pages(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, f"u{i}", *made_page(rng)) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string, want string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in html_text.op7(spark, str(tmp_path)).collect()}
    for i, url, page, want in rows:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want)), page


# substrings


def plain_sentences(text):
    """The sentences, word by word: none of the operator's code. Texts have no abbreviations but initials and short numbers."""
    out, close = [], "\"'”’“»«)]"
    for line in text.split("\n"):
        own, first = [], len(out)
        words = line.split()
        for k, w in enumerate(words):
            own.append(w)
            bare = w.lstrip("(\"'“„«¿¡")
            initial = re.fullmatch(r"([A-ZÀ-Ý]|[0-9]{1,2}|Mr|Mrs|Ms|Dr|Prof|St|Jr|Gen|Rev|vs|cf|Fig|approx|bzw|ca|Nr|vgl|Str|Hr|Fr|Abb|MM|Mme|Mlle|av|env|Sra|Srta|Sr|Ud|Uds|EE|UU|pág|núm)\.", bare)
            second = k + 1 < len(words) and re.match(r"(B|h|a|g|e|ex|ej)\.", words[k + 1])
            if (w[-1] in ".!?…" and not second and not (initial and k + 1 < len(words))) or (len(w) > 1 and w[-1] in close and w[-2] in ".!?…"):
                out, own = [*out, own], []
        if own:
            out.append(own)
        if len(out) > first and len(out[-1]) > 60 and not re.search("[.!?…][" + re.escape(close) + "]*$", out[-1][-1]):
            own, rest = [], out.pop()
            for w in rest:
                if len(own) >= 6 and w[0].isupper():
                    out, own = [*out, own], []
                own.append(w)
            out.append(own)
    return out


def brute_spans(texts):
    """Of (id, sentences) in order: the sentences in runs of two or more with 18 words or more that have occurred before. Every run of every text is looked at."""
    seen, gone = set(), defaultdict(set)
    for i, own in texts:
        runs = {}
        for a in range(len(own)):
            words, h = 0, 0
            for b in range(a, len(own)):
                words, h = words + own[b].count(" ") + 1, hash((h, own[b]))
                if words >= 18 and b > a:
                    if h in seen or h in runs:
                        gone[i].update(range(a, b + 1))
                    runs.setdefault(h, a)
        seen |= runs.keys()
    return dict(gone)


def brute_removed(rows):
    return brute_spans((i, [lower(" ".join(w)) for w in plain_sentences(t or "")]) for i, t in sorted(rows))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_known_sentences(spark, seed):
    """Sentences are given, so neither the cutter nor the choice of spans is in the expectation."""
    rng = np.random.default_rng(seed)
    words = [*"Stadt Brot der the river went Paris con de la calle avec naïve Ödön Familie under".split(), "Mme. Duval", "Dr. J. Weiß", "z. B.", "3. Mai,"]

    def sentence(k):
        return " ".join(["Am", *rng.choice(words, rng.integers(0, 12)), f"n{k}", rng.choice(["end.", "fin!", "Ende?", 'said."', "wohl…", "(so.)"])])

    pool, texts = [sentence(k) for k in range(70)], []
    for i in range(60):
        own = [sentence(1000 * (i + 1) + k) for k in range(rng.integers(0, 12))]
        for _ in range(rng.integers(0, 3)):
            at, n, to = rng.integers(60), int(rng.integers(1, 8)), rng.integers(len(own) + 1)
            own[to:to] = pool[at : at + n]
        texts.append((i, own))
    df = spark.createDataFrame([(i, (" ", "\n")[i % 2].join(own)) for i, own in texts], "doc_id long, text string")
    got = {r.doc_id: (set(r.gone or []), r.text.split()) for r in substring_dedup.remove_repeats(df, "gone").collect()}
    want = brute_spans((i, [lower(" ".join(x.split())) for x in own]) for i, own in texts)
    assert len(want) > 15
    for i, own in texts:
        assert got[i] == (want.get(i, set()), [w for k, x in enumerate(own) if k not in want.get(i, ()) for w in x.split()])


def test_german_nouns_and_names_stay_in_their_sentences():
    for text in ("Die Frau ging am frühen Morgen in die Stadt und kaufte dort im Laden das Brot für ihre Familie.", "We went with all of our old friends to Paris in spring.", "Am 3. Mai kam Dr. J. Weiß z. B. nach Bonn, d. h. spät."):
        assert substring_dedup.sentences(text) == [(0, len(text))]
    open_ = "and so on without an end mark in sight " * 8
    assert len(substring_dedup.sentences(open_ + "Then it began again and again and again Here")) == 3
    assert len(substring_dedup.sentences(open_ + "Then it began again and again and again Here.")) == 1


def test_short_sentences_are_spans_together(spark):
    four = "We saw the boats come in that day. They brought fish and salt for us all. Nobody asked where they had come from. The market opened late and closed early."
    one = "A single long sentence, of more than thirty words, that stands in two texts is no run of several sentences, and so it stays in both of them however long it may be in the end."
    df = spark.createDataFrame([(1, "Here it starts. " + four + " Here it ends."), (2, "Other start. " + four + " Other end."), (3, "One. " + one + " Two."), (4, "Three. " + one + " Four.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert got[2] == "Other start. Other end." and one in got[3] and one in got[4]


def plain_cut(text, gone):
    """The words that stay."""
    return [w for k, s in enumerate(plain_sentences(text or "")) if k not in gone for w in s]


def copied(rows, keep):
    """rows with passages of some copied into others, so that there is something to find."""
    rng, out = np.random.default_rng(5), []
    source = [s for _, t in rows for s in [plain_sentences(t or "")] if len(s) > 12]
    for i, t in rows:
        own = [" ".join(s) for s in plain_sentences(t or "")]
        if source and rng.random() < 0.5:
            other, n = source[rng.integers(len(source))], int(rng.integers(1, 9))
            at, to = rng.integers(len(other) - n), rng.integers(len(own) + 1)
            own[to:to] = [" ".join(s) for s in other[at : at + n]]
        out.append((i, "\n".join(own) if i % 3 else " ".join(own)))
    return [(i, t) for i, t in out if keep(t)]


def test_op8_is_brute_force(spark, docs, tmp_path):
    rows = copied([tuple(r) for r in docs.where("length(text) < 12000").select("doc_id", "text").orderBy("doc_id").collect()], lambda t: len(t) < 15_000)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, got = brute_removed(rows), {r.doc_id: r for r in substring_dedup.op8(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and len(want) > 30
    assert {i: set(r.removed_sentences) for i, r in got.items() if r.n_removed} == want
    for i, t in rows:
        assert (got[i].text or "").split() == plain_cut(t, want[i]) if i in want else got[i].text == t


def test_op8_is_over_the_whole_table(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in substring_dedup.op8(spark, sf_dir).collect()}
    assert len(rows) == docs.count()
    assert all((rows[r.doc_id].text or "").split() == plain_cut(r.text, rows[r.doc_id].removed_sentences) if rows[r.doc_id].n_removed else rows[r.doc_id].text == r.text for r in docs.collect())


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([". ", "\n", "! ", " ", "。", "? ", " \n\n "])), max_size=30))
def test_sentences_cover_the_text(parts):
    text = "".join(f"W{k} " + " ".join("x" * n) + end for k, (n, end) in enumerate(parts))
    where = substring_dedup.sentences(text)
    assert "".join(text[a:b] for a, b in where).split() == text.split() or [w for a, b in where for w in text[a:b].split()] == text.replace("。", "。 ").split()
    assert all(not text[b:c].strip() for (_, b), (c, _) in zip(where, where[1:], strict=False)) and all(a < b for a, b in where)


def test_text_without_spaces_has_spans(spark):
    passage = "".join(f"{'春夏秋冬' * 3}{chr(0x4E00 + k)}。" for k in range(12))
    df = spark.createDataFrame([(1, passage), (2, "東西南北" * 4 + "。" + passage + "東西。")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()} == {1: passage, 2: "東西南北" * 4 + "。東西。"}


def test_a_passage_goes_where_it_comes_again(spark, odd, empty):
    passage = "It was late in the year when they came to town. Nobody had asked them to come, and nobody knew how long they would stay. They took rooms at the inn by the river. Every morning they walked along the water and counted the boats that came in from the sea."
    rows = [(1, "Own start here. " + passage + " Own end."), (2, "Another start, and long. " + passage.replace("They", "they") + "\nAnother end."), (3, passage), (4, "Short and clean. It was late."), (5, passage + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("AT", F.lit(1)).withColumn("h1", F.lit(2))
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: rows[0][1], 2: "Another start, and long. Another end.", 3: "", 4: rows[3][1], 5: ""}
    out = substring_dedup.remove_repeats(odd)
    assert out.count() == len(ODD) and out.columns == odd.columns and out.where("doc_id = 1").first().text is None
    assert substring_dedup.remove_repeats(empty).count() == 0


# packing


def test_packed_pieces(spark, docs, odd, empty):
    tok = packing.tokenizer(WORDS)
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows, src = packing.pack_documents(df, WORDS).toPandas(), {r.doc_id: r.text for r in df.collect()}
        assert set(rows.doc_id) == set(src)
        for i, g in rows.sort_values("start").groupby("doc_id"):
            ids = np.array([*tok.encode(src[i] or "", add_special_tokens=False).ids, 1], "<u4")
            assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all()
            assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
        rows = rows.sort_values(["sequence_id", "offset"])
        used = rows.groupby("sequence_id").length.sum()
        assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and used.max() <= 2048
        assert sorted(used.index) == list(range(len(used)))
        if df is docs:
            assert (2048 * len(used) - used.sum()) / used.sum() < 0.03
            placed = packing.pack_documents(df, WORDS)
            out = {r.sequence_id: r.ids for r in packing.sequences(df, placed, WORDS).collect()}
            assert all(len(v) == 2048 or len(v) & (len(v) - 1) == 0 for v in out.values()) and sum(map(len, out.values())) <= 2048 * len(used)
    assert packing.pack_documents(odd, WORDS).groupBy("doc_id").count().count() == 8 and packing.pack_documents(empty, WORDS).count() == 0


ENCODER = packing.Encoder(WORDS)


def encoded(texts):
    ids, at = ENCODER.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def library(texts):
    return [ENCODER.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(deadline=None, max_examples=300)
@given(st.lists(TEXTS | st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text(st.sampled_from(list("theing'sßéÏŉĳſ.!'<|> \nK1")), max_size=40), max_size=6))
def test_encoder_is_the_library(texts):
    assert encoded(texts) == library(texts)


def test_encoder_knows_every_letter_and_length():
    cased = [f"a{chr(c)}B{chr(c)}." for c in range(0x20, 0x3000) if chr(c).lower() != chr(c) or chr(c) in packing.LETTERS]
    long = ["ab" * n + "." * k for n in (0, 1, 19, 20, 21, 50) for k in (0, 1, 40, 41)]
    for texts in (cased, long, [None, "", " ", "\n", "  a  "], [" ".join(cased)]):
        assert encoded(texts) == library(texts)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 5)
    own = packing.Encoder(WORDS)
    for texts in (["one two three four five six seven one"], ["six seven eight nine ten, one"], ["one two."]):
        assert own.encode(pa.array(texts))[0].tolist() == library(texts)[0]


@pytest.mark.parametrize("sizes", [[85, 86, 87, 128, 129, 43], range(60, 130), [1, 2, 3], range(1, 257), [200, 201], [256, 1]])
def test_patterns_use_every_item_once(sizes):
    for scale in (1, 10**7):
        counts = np.bincount(np.random.default_rng(1).choice(list(sizes), 400), minlength=257) * scale
        plan = packing.patterns(counts, 256)
        used = sum(np.bincount([c for c, n in p.items() for _ in range(n)], minlength=257) * t for p, t in plan)
        assert (used == counts).all() and all(sum(c * n for c, n in p.items()) <= 256 for p, _ in plan)


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 257, 20_000), minlength=257)
    plan = packing.patterns(counts, 256)
    used = np.zeros(257, int)
    for p, times in plan:
        assert sum(c * n for c, n in p.items()) <= 256
        for c, n in p.items():
            used[c] += n * times
    assert (used == counts).all() and sum(t for _, t in plan) <= 1.02 * (counts * np.arange(257)).sum() / 256


# sharding


def test_shards(spark, sf_dir, docs, odd, empty):
    got = sharding.op10(spark, sf_dir).toPandas()
    src = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == len(src) and all(n == len(src[i]) + 1 and c == zlib.crc32(src[i]) for i, n, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True))
    assert got.shard.between(0, 15).all() and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for df in (odd, odd.union(odd)):
        out = sharding.shard(df, shards=4).collect()
        assert len(out) == df.count() and {r.shard for r in out} <= set(range(4))
    assert sharding.shard(empty, shards=4).count() == 0 and sharding.shard(odd, target_bytes=20_000).agg(F.max("shard")).first()[0] >= 3


def test_shards_are_even(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    sizes = [r.s for r in sharding.shard(df, shards=5).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 5 and max(sizes) < 1.05 * min(sizes)


def test_many_shards_with_few_bins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_ROWS", 300)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 31).cast("int")).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 7).cast("string").alias("source"))
    df = df.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    got = sharding.shard(df, shards=37).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == 4000 and len(size) == 37 and size.max() < 1.1 * size.min()


def test_equal_texts_share_a_shard(spark):
    def text(name, words):
        return " ".join(f"{name}{i}" for i in range(words))

    one = [(i, text(f"d{i}x", 20)) for i in range(3000)]
    groups = {text("copy", 1000): 8, text("pair", 900): 2, text("many", 3): 1000, text("torn", 30): 1500}
    more = [t for t, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate([*one, *((0, t) for t in more)])], "doc_id long, text string")
    got = sharding.shard(df, shards=8).join(df, "doc_id").toPandas()
    even = got["size"].sum() / 8
    held = got.groupby("text").agg(size=("size", "sum"), shards=("shard", "nunique"))
    assert (held.shards[held["size"] <= even] == 1).all()
    torn = held[held["size"] > even]
    assert len(torn) == 1 and (torn.shards > 1).all()
    assert got.groupby("shard")["size"].sum().max() < 1.03 * even and got.shard.nunique() == 8


def brute_leaves(rows, leaves, whole):
    """The leaves of the tree over (key, weight, coordinates), by sorting."""
    if leaves == 1:
        return [rows]
    span = [max(r[2][d] for r in rows) - min(r[2][d] for r in rows) for d in range(4)]
    d = max(range(4), key=lambda d: (span[d] / whole[d], -d))
    rows, goal, below, k = sorted(rows, key=lambda r: r[2][d]), sum(r[1] for r in rows) * (leaves // 2) / leaves, 0, 0
    while below + rows[k][1] <= goal:
        below += rows[k][1]
        k += 1
    k += below + rows[k][1] - goal < goal - below  # nearer with it than without
    return brute_leaves(rows[:k], leaves // 2, whole) + brute_leaves(rows[k:], leaves - leaves // 2, whole)


@pytest.mark.parametrize("shards", [4, 7])
def test_shards_are_the_leaves_of_a_sorted_tree(spark, shards):
    rng = np.random.default_rng(shards)
    rows = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(rng.integers(1, 30))), rng.choice(["en", "fr", "de"]), f"s{rng.integers(20)}") for i in range(4000)]
    df = spark.createDataFrame([tuple(map(lambda x: x.item() if hasattr(x, "item") else x, r)) for r in rows], "doc_id long, text string, lang string, source string")
    sized = sharding.sized(df)
    total = sized.agg(F.sum("size")).first()[0]
    _, units = sharding.units(sized, total / shards, 4)
    held = [(bytes(u.key), u.w, [u.x0, u.x1, u.x2, u.x3]) for u in units.collect()]
    whole = [max(u[2][d] for u in held) - min(u[2][d] for u in held) for d in range(4)]
    want = {hashlib.md5(t.encode()).digest(): i for i, t, _, _ in rows}
    leaves = [{want[k] for k, _, _ in leaf} for leaf in brute_leaves(held, shards, whole)]
    got = [set() for _ in range(shards)]
    for r in sharding.shard(df, shards=shards).collect():
        got[r.shard].add(r.doc_id)
    assert got == leaves


def test_clean_keeps_columns_of_any_name(spark):
    text = " ".join(f"word{k}" for k in range(60)) + ".\nClick here"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("__t", "__W", "__l", "kept", "n_words", "clean_text", "row", "a.b")})
    (r,) = quality_rules.clean(df).collect()
    assert quality_rules.clean(df).columns == df.columns and r.text == text.split("\n")[0] and set(r[2:]) == {7}
    assert quality_rules.measured(df).first()["__t"] == 7


def test_the_model_of_an_id_with_two_texts_is_always_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.withColumn("text", F.reverse("text")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one, two = (quality_model.train(quality_model.features(d), labels) for d in (twice, twice.repartition(7, "text")))
    x = np.random.default_rng(0).random((50, len(quality_model.FEATURES))) * 3
    assert (one.score(x) == two.score(x)).all()


# pipeline


def test_pipeline_stages(spark, sf_dir, docs):
    at, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        out = stage(spark, at, sf_dir)
        assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in out.collect()}
        assert rows.keys() <= before.keys()
        if name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[lower(t)] = max(i, last.get(lower(t), i))
            assert set(rows) == set(last.values())
        elif name == "near_dedup":
            assert set(rows) == {c for _, _, c in brute_simhash(before.items())}
        elif name == "substring_dedup":
            gone = brute_removed(before.items())
            assert all((rows[i] or "").split() == plain_cut(t, gone[i]) if i in gone else rows[i] == t for i, t in before.items())
        elif name == "quality":
            good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            kept, bad = ([i in rows for i, q in good.items() if q == k and i in before] for k in (1, 0))
            assert sum(kept) >= 0.97 * len(kept) and sum(bad) <= 0.2 * len(bad)
        at = spark.createDataFrame(out.collect(), docs.schema)
        names.append(name)
    assert names == ["quality", "exact_dedup", "near_dedup", "substring_dedup"]
    assert {r.doc_id for r in corpus_pipeline.packed(spark, at, sf_dir).collect()} == {r.doc_id for r in at.collect()}


def test_pipeline_of_odd_rows(spark, sf_dir, odd, empty):
    for df in (odd, empty):
        at = df
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf_dir)
        assert at.count() >= 0


def test_another_text_under_the_same_id_stays(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (None, one), (None, "own")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()} == {(1, two), (2, one), (None, "own")}
    assert {(r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect()} == {(1, one), (1, two), (None, one), (None, "own")}


def test_names():
    q = queries.queries()
    assert len(q) == 14 and set(queries.oracle_sql()) <= set(q) and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 14))
