"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at line ends, after . ! ? ... before white space (and quotes or brackets that close there), and after
their full-width forms. A full stop after an abbreviation, an initial or a one- or two-digit number ends nothing. Only what has no end mark for more than
``OPEN_STRETCH`` words, not even at its own end, is cut at capital letters, after ``OPEN_WORDS`` words or more. A span is a run of
two or more consecutive sentences with ``MIN_WORDS`` words or more in all. All spans that occur before, by (doc_id, place), lose their sentences
here; the first one of each keeps them. The word bound leaves common lines alone.

Not every span has to be hashed for that: the shortest span from each sentence on and the shortest one up to each sentence
do. Whatever longer span comes again, those of its own sentences come again with it, and together they cover it: where a
sentence's shortest span would reach beyond, what is left is no span, and the shortest one up to the last
sentence, which is one, begins before it. So there are two hashes a sentence at most (128 bits; white space made single, A-Z lower-cased).

The spans are written once and joined globally. Repeats inside one text are seen while it is read; the least doc_id of a hash is combined
before the shuffle and written, and the join back is a plain equi-join that Spark can split where one passage is
everywhere. It gives every span once, marked or not, and what is marked is gathered by document as (first sentence, number):
overlapping spans are united while the text is cut.

Null text is empty. Rows with a null doc_id neither give nor lose spans. Rows that repeat a doc_id are the same
document: they don't take spans from one another, and sentences that go go in all of them. Empty tables give empty
results. Other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import free_name, written
from newsfold.llm.text import documents

MIN_SENTENCES, MIN_WORDS, OPEN_STRETCH, OPEN_WORDS = 2, 18, 60, 6
#: "z. B." and its like aren't cut inside either.
_END = re.compile(r"(?<=[.!?\u2026])\s+(?!(?:B|h|a|g|e|ex|ej)\.)|(?<=[.!?\u2026][\"'\u201d\u2019\u201c\u00bb\u00ab)\]])\s+|\n\s*|(?<=[。！？])\s*")
#: A text's last characters that tell a stretch with an end mark.
_MARKED = re.compile(r"[.!?\u2026。！？][\"'\u201d\u2019\u201c\u00bb\u00ab)\]]*\s*$")
#: Words before a full stop that end no sentence: initials, short numbers, and abbreviations of the four languages.
_ABBREVIATED = re.compile(
    r"(?:^|[\s(\"'\u201c\u201e\u00ab\u00bf\u00a1])(?:[A-Z\u00c0-\u00dd]|\d{1,2}|Mr|Mrs|Ms|Dr|Prof|St|Jr|Gen|Rev|vs|e\.g|i\.e|cf|Fig|approx|bzw|ca|Nr|z\.\s?B|d\.\s?h|u\.\s?a|vgl|Str|Hr|Fr|Abb|MM|Mme|Mlle|p\.\s?ex|av|env|Sra|Srta|Sr|Ud|Uds|EE|UU|pág|núm|p\.\s?ej)\.$"
)
#: Where a sentence may begin without an end mark before it; whether the letter is a capital is looked up.
_OPEN = re.compile(r"\s+(?=[^\Wa-z\d_])")
#: Scripts without spaces between words: two letters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")


def _parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a sentence that begin with a capital after ``OPEN_WORDS`` words."""
    out, at = [], start
    for m in _OPEN.finditer(text, start, end):
        if text[m.end()].isupper() and len(text[at : m.start()].split()) >= OPEN_WORDS:
            out.append((at, m.start()))
            at = m.end()
    return [*out, (at, end)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; what lies between two of them is white space."""
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        end, to = m.span() if m else (len(text), len(text))
        if m and text[end - 1] == "." and "\n" not in text[end:to] and _ABBREVIATED.search(text, max(0, end - 8), end):
            continue
        own = text[at:end]
        if own and not own.isspace():
            if own.count(" ") < OPEN_STRETCH or _MARKED.search(own) or len(own.split()) <= OPEN_STRETCH:
                out.append((at, end))
            else:
                out += _parts(text, at, end)
            at = to
        elif not out:
            at = to
    return out


def spans(text: str) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, sentences) of the shortest spans from and up to each sentence of a text."""
    words = [text[a:b].encode().lower().split() for a, b in sentences(text)]
    size, line = [len(w) for w in words], [b" ".join(w) for w in words]
    if not text.isascii() and _UNSPACED.search(text):
        size = [n + len(_UNSPACED.findall(x.decode())) // 2 for n, x in zip(size, line, strict=True)]
    count, runs = len(size), []
    held = end = 0
    for i in range(count):
        while end < count and (held < MIN_WORDS or end - i < MIN_SENTENCES):
            held += size[end]
            end += 1
        if held < MIN_WORDS or end - i < MIN_SENTENCES:
            break
        runs.append((i, end))
        held -= size[i]
    held, start, known = 0, count, set(runs)
    for k in range(count, 0, -1):
        while start > 0 and (held < MIN_WORDS or k - start < MIN_SENTENCES):
            start -= 1
            held += size[start]
        if held < MIN_WORDS or k - start < MIN_SENTENCES:
            break
        if (start, k) not in known:
            runs.append((start, k))
        held -= size[k - 1]
    return [(xxhash.xxh3_128_digest(b"\n".join(line[i:k])), i, k - i) for i, k in sorted(runs)]


def span_rows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, at, n, again) of all spans; again: the text has had the span before."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])

    def run(batches):
        for batch in batches:
            digests, ids, at, n, again = [], [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                seen: set[bytes] = set()
                for d, k, m in spans(t.as_py() or ""):
                    digests.append(d)
                    ids.append(i)
                    at.append(k)
                    n.append(m)
                    again.append(d in seen)
                    seen.add(d)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(again, pa.bool_())], schema=schema)

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(run, "h1 long, h2 long, doc_id long, at int, n int, again boolean")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, gone) of the documents that have a non-first span, written; gone: these spans as (at, n)."""
    rows = written(span_rows(docs))  # read three times
    own = rows.where(~F.col("again"))
    shared = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    shared = written(shared.where("first_id < last_id").select("h1", "h2", "first_id"))
    later = own.join(shared.hint("shuffle_merge"), ["h1", "h2"], "left").where(F.col("doc_id") > F.coalesce("first_id", "doc_id"))
    gone = later.select("doc_id", "at", "n").unionByName(rows.where("again").select("doc_id", "at", "n"))
    return written(gone.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("gone")))


def cut(text: str, gone: list[int]) -> str:
    """The text without these sentences and the white space after each."""
    drop, where = set(gone), sentences(text)
    keep, at = [], 0
    for k, (start, _) in enumerate(where):
        if k in drop:
            keep.append(text[at:start])
            at = where[k + 1][0] if k + 1 < len(where) else len(text)
    keep.append(text[at:])
    return "".join(keep).strip()


def _cut_all(text: pd.Series, spans_: pd.Series) -> pd.DataFrame:
    """The text left and the sentences that went, of the rows that have spans."""
    left, gone = [], []
    for t, own in zip(text, spans_, strict=True):
        if own is None:
            left.append(None)
            gone.append(None)
        else:
            gone.append(sorted({k for x in own for k in range(x["at"], x["at"] + x["n"])}))
            left.append(cut(t or "", gone[-1]))
    return pd.DataFrame({"text": pd.Series(left, dtype=object), "gone": pd.Series(gone, dtype=object)})


def remove_repeats(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with the repeated sentences cut out of ``text``; removed: a column to add, the numbers of the sentences that went.

    Texts that lose nothing stay as they are, and ``removed`` is null there. Texts and spans meet by id in a merge join at any
    size, as the spans grow with the corpus. Only texts that lose something go through Python.
    """
    key, spans_, out = (free_name(docs, n) for n in ("__id", "__spans", "__out"))
    joined = docs.join(covered(docs).select(F.col("doc_id").alias(key), F.col("gone").alias(spans_)).hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col(key), "left")
    own = F.pandas_udf(_cut_all, "text string, gone array<int>")(F.when(F.col(spans_).isNotNull(), F.col("text")), F.col(spans_))
    left = F.when(F.col(spans_).isNotNull(), F.col(f"{out}.text")).otherwise(F.col("text")).alias("text")
    more = [F.when(F.col(spans_).isNotNull(), F.col(f"{out}.gone")).alias(removed)] if removed else []
    kept = [left if c == "text" else F.col(f"`{c}`") for c in docs.columns if not removed or c.lower() != removed.lower()]
    return joined.withColumn(out, own).select(*kept, *more)


def op8(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), "gone")
    return rows.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed_sentences"), "text")
