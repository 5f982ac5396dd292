"""Line-first cleaning in built-in functions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that loses more
than ``MAX_LOST`` of its characters is rejected. Base rules on the whole text come first: too few words, or too many
words in repeated three-word windows.

Null text is empty: it has no words and fails the base rules. Repeated rows give equal rows; empty tables give none;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import free_name
from newsfold.llm.text import body, documents

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 0.5, 0.5
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: A line of menu entries has so many separators and one for so many characters at most.
BARS, CHARS_PER_BAR = 3, 40
#: Symbols and shouts that a line may have for each of its characters.
LINE_SYMBOLS, LINE_SHOUTS = 0.08, 0.08
BOILERPLATE = r"(all rights reserved|cookie policy|privacy policy|terms of (use|service)|licensed under|released under|this work is licensed|sign up for|subscribe to|click here|share this|powered by|enable javascript|back to top|skip to (main )?content)"
#: A line with a boilerplate phrase goes if it has at most so many characters.
BOILERPLATE_CHARS = 200


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def lost(c: Column, chars: str) -> Column:
    """How many of these characters c has."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def good_line(line: Column) -> Column:
    """Whether a line passes: blank lines do."""
    n = F.length(line)
    bars = lost(line, "|»›")
    navigation = (bars >= BARS) & (bars * CHARS_PER_BAR >= n)
    punctuation = (lost(line, SYMBOLS) > LINE_SYMBOLS * n) | (lost(line, "!") > LINE_SHOUTS * n)
    boilerplate = (n <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE)
    return ~(navigation | punctuation | boilerplate)


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Equal windows have equal hashes, so a text whose windows' hashes all differ has none. The windows of the others are
    sorted, so that equal ones stand side by side.
    """
    places = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    windows = F.transform(places, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i")))

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        again = F.filter(s, lambda x, i: F.when(i > 0, same(x, s[i - 1])).otherwise(False) | F.when(i < last, same(x, s[i + 1])).otherwise(False))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(w) < 3, 0).when(F.size(F.array_distinct(hashes)) == F.size(w) - 2, 0).otherwise(let(F.sort_array(windows), covered))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts, ``clean_text`` (the lines that pass) and the verdicts, each under a name of its own.

    Columns of docs with one of these names are replaced.
    """
    whole, own, lines = (free_name(docs, n) for n in ("__t", "__w", "__l"))
    t, w, l = F.col(whole), F.col(own), F.col(lines)
    out = docs.withColumns({whole: body(text), own: words(body(text)), lines: F.filter(F.split(body(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": lost(t, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            "n_repeat_words": let(w, repeated_words).cast("long"),
            "clean_text": F.array_join(F.filter(F.split(t, "\n"), good_line), "\n"),
            "clean_chars": F.aggregate(F.filter(l, good_line), F.lit(0), lambda n, x: n + F.length(x)).cast("long"),
            "line_chars": F.aggregate(l, F.lit(0), lambda n, x: n + F.length(x)).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("clean_chars") >= (1 - MAX_LOST) * F.col("line_chars"))).drop(whole, own, lines)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their cleaned texts; all other columns, whatever their names, stay as they are."""
    rows = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")).where("kept")
    return rows.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    rows = measured(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
a as (
  select r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda w: w <> '') as w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) as l from d),
p as (
  select r, unnest(w) as x, generate_subscripts(w, 1) as i from a),
v as (
  select r, i, x, lead(x) over (partition by r order by i) as y, lead(x, 2) over (partition by r order by i) as z from p),
c as (
  select r, i, count(*) over (partition by r, x, y, z) as n from v where z is not null),
rep as (
  select r, count(distinct i + k) as n_repeat_words from c, (select unnest([0, 1, 2]) as k) where n > 1 group by r),
ln as (
  select r, unnest(l) as x from a),
lm as (
  select r, length(x) as n, length(x) - length(translate(x, '|»›', '')) as bars,
    length(x) - length(translate(x, '{SYMBOLS}', '')) as syms, length(x) - length(translate(x, '!', '')) as shouts,
    regexp_matches(lower(x), '{BOILERPLATE}') as boiler from ln),
lc as (
  select r, sum(n) as line_chars, coalesce(sum(n) filter (where not ((bars >= {BARS} and bars * {CHARS_PER_BAR} >= n)
    or syms > {LINE_SYMBOLS} * n or shouts > {LINE_SHOUTS} * n or (n <= {BOILERPLATE_CHARS} and boiler))), 0) as clean_chars
  from lm group by r),
m as (
  select a.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(line_chars, 0) as line_chars, coalesce(clean_chars, 0) as clean_chars
  from a left join rep using (r) left join lc using (r)),
b as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {int(100 * MAX_REPEATED)} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and clean_chars >= {1 - MAX_LOST} * line_chars as kept from b
"""
