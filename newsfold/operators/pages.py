"""Operators over pages (page_id, url, html) and document texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfold.functions import markup
from newsfold.functions.urls import CANONICAL, MOVED

#: Trigrams in a language's profile, and the chance of one that a profile lacks.
PROFILE, UNSEEN = 300, 1e-6
#: Characters whose trigrams are held at once, about.
SLICE = 1_000_000
NAVIGATION = "^/?$|^/(tag|tags|category|author|search|login|page|index)(/|$|\\.)"


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of the links inside a page's own host, resolved, without navigation pages and repeats."""
    raw = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)))).alias("raw")
    scheme = F.regexp_extract("url", "^([a-z]+)://", 1)
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    folder = F.regexp_extract("url", "^([a-z]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    rows = pages.select("page_id", scheme.alias("scheme"), host.alias("host"), folder.alias("folder"), raw)
    rows = rows.where(~F.col("raw").rlike("^(?!https?:)[a-z]+:"))
    href = (
        F.when(F.col("raw").rlike("^https?://"), F.col("raw"))
        .when(F.startswith("raw", F.lit("//")), F.concat("scheme", F.lit(":"), "raw"))
        .when(F.startswith("raw", F.lit("/")), F.concat("scheme", F.lit("://"), "host", "raw"))
        .otherwise(F.concat(F.when(F.endswith("folder", F.lit("/")), F.col("folder")).otherwise(F.concat("folder", F.lit("/"))), "raw"))
    )
    rows = rows.select("page_id", "host", href.alias("href"))
    path = F.regexp_extract("href", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return rows.where((F.regexp_extract("href", "^[a-z]+://([^/?#]*)", 1) == F.col("host")) & ~path.rlike(NAVIGATION)).select("page_id", "href").distinct()


def _per_page(pages: DataFrame, fn, schema: str) -> DataFrame:
    """One pass of Arrow batches; fn: (page_id, url, page) -> rows."""

    def run(batches):
        for pdf in batches:
            rows = [r for i, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True) for r in fn(i, u, markup.Page(h if isinstance(h, str) else ""))]
            yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown): headings, items and links of the visible text."""
    return _per_page(pages, lambda i, _, p: [(i, p.markdown())], "page_id long, markdown string")


def extract_pages(pages: DataFrame, now: Column | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Pages as articles: title, text, author, language, canonical URL, times, paywall flag; ``error`` where that failed.

    A page's date is its update time; without one it counts as created now. Another canonical URL makes the page's own
    one a moved link. No page ends the job. With profiles (see ``language_profiles``) the language of pages that give
    none is detected from their text.
    """

    def read(i, url, p: markup.Page):
        text = p.text()
        title = p.meta.get("og:title") or p.title or None
        paid = bool(markup.paywall(p)[0])
        error = p.error or (None if text else "no text")
        yield (i, url, title, text or None, p.meta.get("author") or None, (p.lang or "")[:2].lower() or None, p.canonical or None, markup.date_of(p), paid, error)

    rows = _per_page(pages, read, "page_id long, url string, title string, text string, author string, language string, canonical string, dated string, paywalled boolean, error string")
    if profiles is not None:
        # within the page's own row, so that no page is read twice
        rows = rows.withColumn("language", F.coalesce("language", likeliest(F.when(F.col("language").isNull(), F.col("text")), profiles)))
    rows = rows.withColumn("updated_at", F.try_to_timestamp("dated"))
    rows = rows.withColumn("created_at", F.when(F.col("updated_at").isNull(), now if now is not None else F.current_timestamp()))
    moved = (F.col("canonical") != "") & (F.col("canonical") != F.col("url"))
    own = F.struct(F.col("url").alias("href"), F.array(F.when(moved, F.lit(MOVED)).otherwise(F.lit(CANONICAL))).alias("labels"))
    urls = F.when(moved, F.array(F.struct(F.col("canonical").alias("href"), F.array(F.lit(CANONICAL)).alias("labels")), own)).otherwise(F.array(own))
    labels = F.when(F.col("paywalled"), F.array(F.lit("paywalled"))).otherwise(F.array().cast("array<string>"))
    return rows.select("page_id", "url", "title", "text", "author", "language", urls.alias("urls"), labels.alias("labels"), "created_at", "updated_at", "paywalled", "error")


def paywall_flag(pages: DataFrame) -> DataFrame:
    """(page_id, paywalled)."""
    return _per_page(pages, lambda i, _, p: [(i, bool(markup.paywall(p)[0]))], "page_id long, paywalled boolean")


def paywall_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, type, tag, value, path, text): each mark that a page isn't free; type error: data that couldn't be read."""

    def read(i, _, p):
        found, errors = markup.paywall(p)
        for m in found:
            yield (i, m["type"], m["tag"], m["value"], m["path"], m["text"])
        for e in errors:
            yield (i, "error", "", "", "", e)

    return _per_page(pages, read, "page_id long, type string, tag string, value string, path string, text string")


def letters(text: Column) -> Column:
    """The lower-cased words between single spaces, with one before and one behind."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " ")), F.lit(" "))


def _trigrams(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of each trigram of the texts, which are numbered from 0: three code points of 21 bits in one number."""
    t = texts.fillna("")
    c = np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64")
    of = np.repeat(np.arange(len(t)), t.str.len().to_numpy("int64"))
    inside = of[:-2] == of[2:]
    return of[:-2][inside], ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside]


def _spelt(grams: np.ndarray) -> list[str]:
    return [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in grams.tolist()]


def _slices(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in runs of some ``SLICE`` characters and of SLICE / 1,000 texts at most."""
    size = texts.str.len().fillna(0).to_numpy("int64")
    at = np.maximum((np.cumsum(size) - size) // SLICE, np.arange(len(texts)) // (SLICE // 1000))
    return (run for _, run in texts.groupby(at))


def language_profiles(docs: DataFrame) -> DataFrame:
    """(language, gram, logp): the commonest trigrams of each language and their chances, over all labelled docs.

    Trigrams are counted by batch before the shuffle: a batch sends each of a language's grams once.
    """

    def run(batches):
        for pdf in batches:
            for language, texts in pdf.groupby("language")["t"]:
                counts: Counter = Counter()
                for own in _slices(texts):
                    grams, k = np.unique(_trigrams(own)[1], return_counts=True)
                    counts.update(dict(zip(grams.tolist(), k.tolist(), strict=True)))
                yield pd.DataFrame({"language": language, "gram": _spelt(np.fromiter(counts.keys(), "int64", len(counts))), "k": list(counts.values())})

    known = docs.where("language is not null").select("language", letters(F.col("text")).alias("t"))
    counts = known.mapInPandas(run, "language string, gram string, k long").groupBy("language", "gram").agg(F.sum("k").alias("n"))
    w = Window.partitionBy("language")
    counts = counts.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "gram")))
    return counts.where(F.col("rn") <= PROFILE).select("language", "gram", F.ln("p").alias("logp"))


def likeliest(text: Column, profiles: DataFrame) -> Column:
    """The language whose profile makes the text's trigrams likeliest; null if none is known.

    A gram of any profile has a chance in each language. That table has ``PROFILE`` rows a language, so it goes to the
    texts; these are scored batch by batch, without a shuffle.
    """
    known = profiles.toPandas()  # PROFILE rows a language
    langs = sorted(known["language"].unique())
    if not langs:
        return F.lit(None).cast("string")
    table = known.pivot(index="gram", columns="language", values="logp").reindex(columns=langs).fillna(math.log(UNSEEN))
    code = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in table.index])
    order = np.argsort(code)
    code, logp = code[order], table.to_numpy()[order]

    def best(texts: pd.Series) -> list[str | None]:
        of, grams = _trigrams(texts)
        at = np.searchsorted(code, grams)
        hit = code[np.minimum(at, len(code) - 1)] == grams
        counts = np.bincount(of[hit] * len(code) + at[hit], minlength=len(texts) * len(code)).reshape(len(texts), len(code))
        score = (counts @ logp).round(6)
        last = len(langs) - 1 - score[:, ::-1].argmax(1)  # of equals the last language
        return [langs[k] if some else None for k, some in zip(last, counts.any(1), strict=True)]

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([x for own in _slices(texts) for x in best(own)], dtype=object)

    return F.pandas_udf(run, "string")(letters(text))


def detect_language(docs: DataFrame, profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, detected): the ``likeliest`` language of each text."""
    return docs.select(key, likeliest(F.col("text"), profiles).alias("detected"))
