"""Spelling variants by permuterm rotations.

A word takes a terminator behind it, and all its rotations are sorted. A rotation that ends with the character c is, without
c, the rest of the word around the place of c: words that differ in one replaced character have a rotation each with one and
the same rest, and a word that lacks c has the rest itself as a whole rotation. So a group of the sorted table, the rotations with
one rest, holds a word for each character that may stand at the skipped place and at most one word without it: its size is bounded by the alphabet,
however many words there are. Each group is scanned once and gives every member its number of near words and the best of
them; no pairs are made. A character deleted from a run of equal ones gives one word whichever of them goes, so only the first of a run
counts as a deletion.

Words are sums over all texts. Null text has no words. A null id is the word ``null`` in the hash of ``misspelt``. Repeated rows count again. Empty
tables give empty results; other columns are ignored. Words may have any character but U+0000, the terminator.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfold.functions.runtime import parts, written
from newsfold.llm.text import documents

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
END = "\x00"
#: Distinct words that a task holds before it passes their counts on; rotations in a sorted part, about.
HELD, ROTATIONS = 200_000, 1_000_000


def misspelt(word: str, seed: int, every: int) -> str:
    """The word without a character if ``every`` divides its crc32, which goes on from seed."""
    h = zlib.crc32(word.encode(), seed)
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = 0) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, with at least min_chars characters and min_count occurrences.

    every: one in so many pairs of document and word is misspelt (0: none), by the crc32 of ``<doc_id>:<word>``.
    """
    runs = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{min_chars},}}")

    def count(batches):
        held: Counter[str] = Counter()

        def flush():
            words, n = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))  # bytes lower-case A-Z alone
                if every:
                    seed = zlib.crc32(f"{i.as_py()}:".encode())
                    for word, n in found.items():
                        held[misspelt(word, seed, every)] += n
                else:
                    held.update(found)
                if len(held) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "text").mapInArrow(count, "word string, n long")
    return rows.where(F.length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(rest, skipped, first, n): every rotation of the words (word, n), whole with ``skipped`` empty, and without its last character.

    first: the skipped character doesn't repeat the one before it.
    """
    w, i = F.col("word"), F.col("i")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    char, last = w.substr(i, F.lit(1)), w.substr(i - 1, F.lit(1))
    after, none = F.concat(w.substr(i + 1, F.length("word")), F.lit(END)), F.lit("")
    whole = F.struct(F.concat(after, F.when(i > 0, w.substr(F.lit(1), i)).otherwise(none)).alias("rest"), none.alias("skipped"), F.lit(False).alias("first"))
    less = F.struct(F.concat(after, F.when(i > 1, w.substr(F.lit(1), i - 1)).otherwise(none)).alias("rest"), char.alias("skipped"), ((i == 1) | (char != last)).alias("first"))
    return at.select(F.explode(F.when(i > 0, F.array(whole, less)).otherwise(F.array(whole))).alias("r"), "n").select("r.*", "n")


def _word(rest: Column, skipped: Column) -> Column:
    return F.concat(F.substring_index(rest, END, -1), skipped, F.substring_index(rest, END, 1))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words that have near ones; best: the near word as (-n, word) of largest n, the least word of equals."""
    spark = words.sparkSession
    rows = words.select(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    table = rotations(words).repartitionByRange(parts(spark, rows, ROTATIONS), "rest")
    # words of a group differ in the skipped character alone, so they are in its order
    group = Window.partitionBy("rest").orderBy(F.desc("n"), "skipped").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("skipped") != "", F.struct("n", "skipped"))
    scanned = table.select(
        "rest", "skipped", "first", F.count(own).over(group).alias("members"), F.count_if((F.col("skipped") != "") & F.col("first")).over(group).alias("firsts"),
        F.first(own, ignorenulls=True).over(group).alias("a"), F.nth_value(own, 2, ignoreNulls=True).over(group).alias("b"),
        F.max(F.when(F.col("skipped") == "", F.col("n"))).over(group).alias("whole"),
    )
    is_whole, one = F.col("skipped") == "", F.when(F.col("first") & F.col("whole").isNotNull(), 1).otherwise(0)
    near = F.when(is_whole, F.col("firsts")).otherwise(F.col("members") - 1 + one)

    def key(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct((-F.col(c)["n"]).alias("n"), _word(F.col("rest"), F.col(c)["skipped"]).alias("word")))

    other = F.when(is_whole | (F.col("a")["skipped"] != F.col("skipped")), key("a")).otherwise(key("b"))
    lacking = F.when(~is_whole & F.col("whole").isNotNull(), F.struct((-F.col("whole")).alias("n"), _word(F.col("rest"), F.lit("")).alias("word")))
    found = scanned.where((F.col("members") > 1) | (F.col("members") > 0) & F.col("whole").isNotNull())
    found = found.select(_word(F.col("rest"), F.col("skipped")).alias("word"), near.alias("near"), F.least(other, lacking).alias("best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) of forms (word, form), a written table: the last form on the way up.

    Each form is ``ratio`` times as frequent as its word at least and none is more frequent than ``most``, which bounds the steps; each round
    doubles the steps that are taken.
    """
    steps, reach = 0, 1
    while most >= ratio ** (steps + 1):
        steps += 1
    at = forms.select("word", F.col("form").alias("root"))
    while reach < steps:
        at = written(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("up")), "root", "left").select("word", F.coalesce("up", "root").alias("root")))
        reach *= 2
    return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    form: the near word of largest n (of equals the least by code points) if that is ``ratio`` (2 at least) times the word's n or more.
    root: what the word's forms lead to, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = written(words.select("word", "n"))
    most = words.agg(F.max("n")).first()[0] or 0
    fits = -F.col("best")["n"] >= ratio * F.col("n")
    rows = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")["word"]).alias("form"), F.when(fits, -F.col("best")["n"]).alias("form_n"))
    rows = written(rows)
    up = roots(written(rows.where("form is not null").select("word", "form")), most, ratio)
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(count_words(documents(spark, sf_dir), every=31))


OP11_SQL = r"""
with recursive
crc as (
  select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, x)) as t),
runs as (
  select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w
  from documents),
own as (
  select id, w, count(*) as k, hex(encode(id || ':' || w)) as b from runs where length(w) >= 7 group by id, w),
hashed as (
  select w, k, xor(4294967295, list_reduce(range(len(b) // 2), lambda c, i: xor(t[1 + (xor(c, 16 * (position(b[2 * i + 1] in '0123456789ABCDEF') - 1) + position(b[2 * i + 2] in '0123456789ABCDEF') - 1) & 255)], c >> 8), 4294967295)) as h
  from own, crc),
spelt as (
  select case when h % 31 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, k from hashed),
words as (
  select word, sum(k)::bigint as n from spelt where length(word) >= 7 group by word having sum(k) >= 2),
less as (
  select word, n, i, left(word, i - 1) as a, substr(word, i + 1) as z from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select x.word, y.word as other, y.n as other_n from less x join less y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word
  union select x.word, y.word, y.n from less x join words y on x.a || x.z = y.word
  union select y.word, x.word, x.n from less x join words y on x.a || x.z = y.word),
best as (
  select word, count(*) as n_near, min_by(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n
  from words left join best using (word)),
up as (
  select word, word as at from words union all select up.word, f.form from up join forms f on f.word = up.at where f.form is not null)
select f.word, f.form, r.at as root, f.n, f.n_near::bigint as n_near, f.form_n from forms f join (select up.word, up.at from up join forms g on g.word = up.at where g.form is null) r on r.word = f.word
"""
