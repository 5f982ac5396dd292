"""Wiki revisions: (pageid, revid, user, ts, comment, tags), editors, trust, revision diffs, token labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfold.functions.runtime import in_order, small, with_halo, written
from newsfold.functions.text import sentences

BLOCKED, REVERT_TAG = "blocked", "mw-reverted"
#: The trust that a group's members have.
TRUST = {"banned": -10000, "blocked": -10000, "bot": 10, "autoconfirmed": 1, "extendedconfirmed": 20, "rollback": 50, "sysop": 100, "bureaucrat": 400, "checkuser": 350, "oversight": 350, "steward": 350}
#: How comments that undo an edit begin.
UNDOING = "(?i)\\b(revert(ed|ing)|undid|undo|rollback|rolled back)\\b"
SIMILAR, ALIGNED, CANDIDATES = 0.75, 0.6, 20


def following_revisions(revisions: DataFrame, n: int) -> DataFrame:
    """(pageid, revid, nth, next_revid, next_ts): the first n revisions of the page a second or more later.

    Revisions and the times from which their followers count are put into one order by page and time, in buckets that no page
    fills alone: the revisions before a time say how the followers are numbered, and they are looked up by these numbers. Rows with a null
    pageid or time follow nothing and have no followers.
    """
    r = revisions.where("pageid is not null").select("pageid", "revid", "ts", F.col("ts").cast("timestamp").alias("t"))
    asked = r.where("t is not null").withColumns({"t": F.col("t") + F.expr("interval 1 second"), "is_row": F.lit(0)})
    both, starts = in_order(asked.unionByName(r.withColumn("is_row", F.lit(1))), ["pageid", "t", "is_row", "revid"], "bucket", "rank")
    both = written(both)
    held = both.groupBy("bucket").agg(F.sum("is_row").alias("held"))
    held = held.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("held"))  # a row for each bucket
    here = F.sum("is_row").over(Window.partitionBy("bucket").orderBy("rank"))
    rows = written(both.withColumn("here", here).join(small(written(held)), "bucket").select("pageid", "revid", "ts", "is_row", (F.col("held") + F.col("here")).alias("no")))
    nth = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("nth")
    wanted = rows.where("is_row = 0").select("pageid", "revid", "no", nth).select("pageid", "revid", "nth", (F.col("no") + F.col("nth")).alias("no"))
    nxt = rows.where("is_row = 1 and ts is not null").select("pageid", "no", F.col("revid").alias("next_revid"), F.col("ts").alias("next_ts"))
    return wanted.join(nxt, ["pageid", "no"]).select("pageid", "revid", "nth", "next_revid", "next_ts")


def previous_notable(revisions: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """(pageid, revid, previous_revid): the latest of the page's ``candidates`` revisions before this one that is by another user or a day older.

    Pages are looked through in buckets of one order by page and time, each with the ``candidates`` rows before it.
    """
    rows, starts = in_order(revisions.select("pageid", "revid", "user", "ts"), ["pageid", "ts", "revid"], "bucket", "rank")
    w = Window.partitionBy("bucket", "pageid").orderBy("rank").rowsBetween(-candidates, -1)
    back = F.collect_list(F.struct("ts", "revid", "user")).over(w)
    old = F.filter("__b", lambda x: (x["user"] != F.col("user")) | (x["ts"] <= F.col("ts") - F.expr("interval 1 day")))
    rows = with_halo(rows, starts, "bucket", "rank", candidates).withColumn("__b", back).where("not halo")
    return rows.select("pageid", "revid", F.try_element_at(old, F.lit(-1))["revid"].alias("previous_revid"))


def is_undo(comment: Column, user: Column, revid: Column) -> Column:
    """Whether a comment undoes an edit: it has a word of undoing and names the edit's user or number as a whole word."""
    c = F.regexp_replace(F.coalesce(comment, F.lit("")), r"/\* .*? \*/", "")

    def names(x: Column) -> Column:
        return F.regexp_like(c, F.concat(F.lit("(?<![\\w])\\Q"), x.cast("string"), F.lit("\\E(?![\\w])")))

    return c.rlike(UNDOING) & (F.coalesce(names(user), F.lit(False)) | F.coalesce(names(revid), F.lit(False)))


def reverted_contributions(revisions: DataFrame, n: int = 3, similarity=None) -> DataFrame:
    """(pageid, revid, user, reverted): tagged as reverted, or undone by one of the next n comments.

    similarity: a function of a comment column to 0..1, instead of the words of undoing.
    """
    near = following_revisions(revisions, n)
    notes = revisions.select("pageid", F.col("revid").alias("next_revid"), F.col("comment").alias("__c"))
    score = similarity(F.col("__c")) >= SIMILAR if similarity else F.lit(True)
    r = revisions.select("pageid", "revid", "user")
    undone = near.join(notes, ["pageid", "next_revid"]).join(r, ["pageid", "revid"]).groupBy("pageid", "revid").agg(F.max(is_undo(F.col("__c"), F.col("user"), F.col("revid")) & score).alias("__undone"))
    tagged = F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), REVERT_TAG)
    return revisions.join(undone, ["pageid", "revid"], "left").select("pageid", "revid", "user", (tagged | F.coalesce("__undone", F.lit(False))).alias("reverted"))


def revert_rates(editors: DataFrame, contributions: DataFrame) -> DataFrame:
    """(user, rate, total, reverted) for each editor; without contributions (null, 0, 0)."""
    g = contributions.groupBy("user").agg(F.count(F.lit(1)).alias("total"), F.count_if("reverted").alias("reverted"))
    rows = editors.select("user").distinct().join(g, "user", "left")
    total, bad = F.coalesce("total", F.lit(0)), F.coalesce("reverted", F.lit(0))
    return rows.select("user", F.try_divide(bad, total).alias("rate"), total.alias("total"), bad.alias("reverted"))


def trust_of(group: Column) -> Column:
    """The trust of a group, whatever its case; 0 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.lower(group)), F.lit(0))


IS_IP = r"^(\d{1,3}(\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*)$"


def power_levels(users: DataFrame, blocks: DataFrame) -> DataFrame:
    """(name, power): the trust of a user's distinct groups, less that of a block; invalid users 0; addresses by blocks alone.

    users: name, groups, blockid, invalid, and where the source says so ``anonymous``, whether the name is an address; else its form decides.
    blocks: ip.
    """
    ip = F.col("name").rlike(IS_IP)
    if "anonymous" in users.columns:
        ip = F.coalesce("anonymous", ip)
    groups = F.array_distinct(F.concat(F.coalesce("groups", F.array().cast("array<string>")), F.when(F.col("blockid").isNotNull(), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))))
    power = F.aggregate(F.transform(groups, trust_of), F.lit(0), lambda s, x: s + x)
    hit = blocks.select(F.col("ip").alias("name"), F.lit(True).alias("__hit")).distinct()
    rows = users.join(hit, "name", "left")
    return rows.select("name", F.when(ip, F.when(F.col("__hit"), F.lit(TRUST[BLOCKED])).otherwise(0)).when(F.coalesce("invalid", F.lit(False)), 0).otherwise(power).alias("power"))


def trust_rank(powers: DataFrame) -> DataFrame:
    """Users with some trust, the most trusted first, names backwards."""
    return powers.where("power > 0").orderBy(F.desc("power"), F.desc("name"))


def review_rank(reviews: DataFrame) -> DataFrame:
    """Flagged reviews (pos, user, level_text, reviewer) with ``score``: reviewed or stable, and by somebody else; best first."""
    score = F.when(F.lower("level_text").isin("reviewed", "stable"), 1).otherwise(0) + F.when(F.col("reviewer") != F.col("user"), 1).otherwise(0)
    return reviews.where("level_text is not null").withColumn("score", score).orderBy(F.desc("score"), "pos")


#: Sentences more alike than this are found by their rarest grams, of so many characters.
ALIKE, GRAM = 0.9, 3


def within(most: Column) -> Column:
    """A row for a row whose ``clean`` and ``changed`` have an edit distance of at most ``most``: the distance.

    Spark stops counting beyond it. It is exploded so that filters on it don't have it computed again.
    """
    return F.explode(F.filter(F.array(F.call_function("levenshtein", F.col("clean"), F.col("changed"), most.cast("int"))), lambda d: d >= 0))


def alike_by_grams(left: DataFrame, right: DataFrame, least: float = ALIKE, q: int = GRAM) -> DataFrame:
    """(pair_id, a, b): candidates among sentences (pair_id, a, clean) and (pair_id, b, changed), with all whose ratio is above ``least``.

    One edit changes q grams at most, so that sentences of up to M characters and a ratio above ``least`` have more than
    M (1 - q (1 - least)) - q + 1 grams in common, counted with repeats. Of each sentence only as many of its grams, the rarest of its pair of
    texts, are looked up as it can't lose all of. Sentences below q characters have no such partner.
    """
    share = 1 - q * (1 - least)

    def numbered(s: Column) -> Column:
        """The grams of a sentence as hashes, each with how often it has come before; equal hashes of others only make more candidates."""

        def hashes(c: Column) -> Column:
            return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(c) - q), lambda i: F.xxhash64(F.slice(c, i + 1, q))))

        def told(g: Column) -> Column:
            return F.transform(g, lambda x, i: F.xxhash64(x, i - F.array_position(g, x)))

        # a lambda's variable is computed once, however often it is looked at
        return F.transform(F.transform(F.array(F.split(s, "")), hashes), told)[0]

    def grams(df: DataFrame, at: str, s: str) -> DataFrame:
        n = F.length(s)
        return df.where(n >= q).select("pair_id", F.col(at).alias("at"), n.alias("n"), F.explode(numbered(F.col(s))).alias("gram"))

    both = written(grams(left, "a", "clean").withColumn("side", F.lit(0)).unionByName(grams(right, "b", "changed").withColumn("side", F.lit(1))))
    held = both.groupBy("pair_id", "gram").agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("pair_id", "side", "at").orderBy("held", "gram"))
    common = F.floor(F.col("n") * share - q + 1 - 1e-9) + 1
    rare = written(both.join(held, ["pair_id", "gram"]).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - q + 2 - F.greatest(common, F.lit(1))))
    a, b = (rare.where(f"side = {k}").select("pair_id", "gram", F.col("at").alias(name), F.col("n").alias(f"n{name}")) for k, name in enumerate("ab"))
    fit = F.least("na", "nb") > least * F.greatest("na", "nb")
    return a.join(b, ["pair_id", "gram"]).where(fit).select("pair_id", "a", "b").distinct()


#: Sentences of a band that one task compares with another's, about.
BLOCK = 500


def of_fitting_length(left: DataFrame, right: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(pair_id, a, clean, b, changed): all sentences of left (pair_id, a, clean) and right (pair_id, b, changed) of a pair whose lengths
    allow a ratio above ``least``.

    Such lengths lie in one band of lengths or in neighbouring ones: a band's longest is 1 / least times its shortest. Sentences meet by
    pair, band and block, of which a band has as many as its clean sentences fill, so that the longest pair of texts is spread over tasks.
    """

    def band(s: str) -> Column:
        return F.floor(F.log(F.length(s)) / (-math.log(least) * 1.001)).cast("int")  # a little wider, for what rounding may do

    l = left.where(F.length("clean") > 0).withColumn("band", band("clean"))
    blocks = l.groupBy("pair_id", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    l = l.join(blocks, ["pair_id", "band"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    r = right.where(F.length("changed") > 0).withColumn("band", F.explode(F.sequence(band("changed") - 1, band("changed") + 1)))
    r = r.join(blocks, ["pair_id", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    fit = F.least(F.length("clean"), F.length("changed")) > least * F.greatest(F.length("clean"), F.length("changed"))
    return l.join(r, ["pair_id", "band", "block"]).where(fit).select("pair_id", "a", "clean", "b", "changed")


def _best(near: DataFrame, least: float) -> DataFrame:
    """(pair_id, b, a, clean, changed, ratio): of candidates (pair_id, a, clean, b, changed) each b with the most alike a, if above least; the first of equals."""
    # a ratio above the threshold bounds the lengths, which is cheap to see first
    fit = near.where(F.least(F.length("clean"), F.length("changed")) > least * F.greatest(F.length("clean"), F.length("changed")))
    longest = F.greatest(F.length("clean"), F.length("changed"))
    close = fit.select("*", within(F.ceil((1 - least) * longest)).alias("d")).withColumn("ratio", 1 - F.col("d") / longest).where(F.col("ratio") > least)
    return close.groupBy("pair_id", "b").agg(F.max_by(F.struct("a", "clean", "changed", "ratio"), F.struct("ratio", (-F.col("a")).alias("n"))).alias("m")).select("pair_id", "b", "m.*")


def _merged(rows: DataFrame) -> DataFrame:
    """rows (pair_id, kind, a, b, clean, changed, ratio) with each island that reads better as one sentence put together.

    Rows go by their changed sentence; a deleted one stands behind the last matched clean sentence before it. An island is all unmatched rows
    between two matched ones. It becomes one row of kind ``merged`` if its clean and its changed sentences, each joined by a blank, are more alike
    than the matched row behind it. Windows lie within a pair of texts.
    """
    by_clean = Window.partitionBy("pair_id").orderBy("a", F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    anchored = rows.withColumn("x", F.coalesce("b", F.when(F.col("a").isNotNull(), F.last(F.when(F.col("ratio").isNotNull(), F.col("b")), ignorenulls=True).over(by_clean)), F.lit(-1)))
    in_order = Window.partitionBy("pair_id").orderBy("x", F.col("b").isNull(), "a")
    placed = anchored.withColumn("island", F.count("ratio").over(in_order) + F.when(F.col("ratio").isNull(), 1).otherwise(0))
    place = F.struct("x", F.col("b").isNull().alias("y"), "a")

    def joined(c: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col("ratio").isNull() & F.col(c).isNotNull(), F.struct(place.alias("at"), F.col(c).alias("s")))))
        return F.array_join(F.transform(parts, lambda x: x["s"]), " ")

    # behind an equal row nothing can be more alike
    found = placed.groupBy("pair_id", "island").agg(joined("clean").alias("clean"), joined("changed").alias("changed"), F.max("ratio").alias("next"))
    longest = F.greatest(F.length("clean"), F.length("changed"))
    found = found.where((F.col("next") < 1) & (F.length("clean") > 0) & (F.length("changed") > 0)).where(F.least(F.length("clean"), F.length("changed")) > F.col("next") * longest)
    found = found.select("*", within(F.ceil((1 - F.col("next")) * longest)).alias("d"))
    better = written(found.withColumn("ratio", 1 - F.col("d") / longest).where(F.col("ratio") > F.col("next")).select("pair_id", "island", "clean", "changed", "ratio"))
    gone = better.select("pair_id", "island", F.lit(True).alias("gone"))
    kept = placed.join(gone, ["pair_id", "island"], "left").where(F.col("gone").isNull() | F.col("ratio").isNotNull()).select("pair_id", "kind", "clean", "changed", "ratio")
    return kept.unionByName(better.select("pair_id", F.lit("merged").alias("kind"), "clean", "changed", "ratio"))


#: A pair of texts of which at most so many pairs of sentences are to be compared has them compared in one row.
COMPARED = 250_000


def _sentence_rows(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, pos, s, other, na, nb), written: each sentence of the clean (side 0) and the changed text (1), with the place of its equal on
    the other side, by occurrence, and how many sentences of each side have none in this pair.

    Pairs are dealt once, and all windows lie within a pair. Null pairs have no equals.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("clean_text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("changed_text").alias("text")))
    texts = pairs.select("pair_id", "clean_text", "changed_text").repartition("pair_id").select("pair_id", F.explode(sides).alias("x"))
    rows = texts.select("pair_id", "x.side", F.posexplode(sentences(F.col("x.text"))).alias("pos", "s"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("pair_id", "side", "s").orderBy("pos")))
    same = Window.partitionBy("pair_id", "s", "nth")
    on = [F.max(F.when(F.col("side") == k, F.col("pos"))).over(same) for k in (0, 1)]
    rows = rows.withColumn("other", F.when(F.col("pair_id").isNotNull(), F.when(F.col("side") == 0, on[1]).otherwise(on[0])))
    left = [F.count(F.when((F.col("side") == k) & F.col("other").isNull(), 1)).over(Window.partitionBy("pair_id")) for k in (0, 1)]
    return written(rows.select("pair_id", "side", "pos", "s", "other", left[0].alias("na"), left[1].alias("nb")))


def _in_row(left: DataFrame) -> DataFrame:
    """(pair_id, kind, a, b, clean, changed, ratio) of the sentences without an equal (pair_id, side, pos, s), of pairs with few of them.

    A pair is a row with the sentences of both sides. Each changed one is held against the clean ones of a length that allows a ratio above
    ``ALIKE`` and, if none is as much alike, against those that allow one above ``ALIGNED``.
    """
    own = F.struct(F.col("pos").alias("pos"), F.col("s").alias("s"), F.length("s").alias("n"))
    both = left.groupBy("pair_id").agg(*[F.collect_list(F.when(F.col("side") == k, own)).alias(c) for k, c in enumerate("lr")])

    def best(r: Column, least: float) -> Column:
        def fit(x: Column) -> Column:
            return F.least(x["n"], r["n"]) > least * F.greatest(x["n"], r["n"])

        def judged(x: Column) -> Column:
            longest = F.greatest(x["n"], r["n"])
            d = F.call_function("levenshtein", x["s"], r["s"], F.ceil((1 - least) * longest).cast("int"))
            return F.struct((1 - F.nullif(d, F.lit(-1)) / longest).alias("ratio"), (-x["pos"]).alias("before"), x["s"].alias("s"))

        return F.array_max(F.filter(F.transform(F.filter("l", fit), judged), lambda m: m["ratio"] > least))

    def row(kind: Column, a: Column, b: Column, clean: Column, changed: Column, ratio: Column) -> Column:
        return F.struct(kind.alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), clean.cast("string").alias("clean"), changed.cast("string").alias("changed"), ratio.cast("double").alias("ratio"))

    none = F.lit(None)
    found = both.withColumn("m", F.transform("r", lambda r: F.struct(r.alias("r"), F.coalesce(best(r, ALIKE), best(r, ALIGNED)).alias("best"))))
    found = found.withColumn("used", F.filter(F.transform("m", lambda m: -m["best"]["before"]), lambda a: a.isNotNull()))
    changed = F.transform("m", lambda m: row(F.when(m["best"].isNull(), "inserted").otherwise("replaced"), -m["best"]["before"], m["r"]["pos"], m["best"]["s"], m["r"]["s"], m["best"]["ratio"]))
    gone = F.transform(F.filter("l", lambda x: ~F.array_contains("used", x["pos"])), lambda x: row(F.lit("deleted"), x["pos"], none, x["s"], none, none))
    return found.select("pair_id", F.explode(F.concat(changed, gone)).alias("x")).select("pair_id", "x.*")


def _over_tasks(left: DataFrame) -> DataFrame:
    """What ``_in_row`` gives, of pairs that may have any number of sentences: they meet by rare grams, and then in blocks."""
    l, r = (written(left.where(F.col("side") == k).select("pair_id", F.col("pos").alias(at), F.col("s").alias(c))) for k, at, c in ((0, "a", "clean"), (1, "b", "changed")))
    alike = written(_best(alike_by_grams(l, r).join(l, ["pair_id", "a"]).join(r, ["pair_id", "b"]), ALIKE))
    rest = r.join(alike.select("pair_id", "b"), ["pair_id", "b"], "left_anti")
    best = alike.unionByName(written(_best(of_fitting_length(l, written(rest), ALIGNED), ALIGNED)))
    deleted = l.join(best.select("pair_id", "a").distinct(), ["pair_id", "a"], "left_anti")
    inserted = r.join(best.select("pair_id", "b"), ["pair_id", "b"], "left_anti")
    return _rows(best, "replaced").unionByName(_rows(deleted, "deleted")).unionByName(_rows(inserted, "inserted"))


def _rows(df: DataFrame, kind: str) -> DataFrame:
    """df as rows (pair_id, kind, a, b, clean, changed, ratio) of a kind; columns that it lacks are null."""
    kinds = {"a": "int", "b": "int", "clean": "string", "changed": "string", "ratio": "double"}
    return df.select("pair_id", F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def align_revisions(pairs: DataFrame, compared: int = COMPARED) -> DataFrame:
    """(pair_id, kind, clean, changed, ratio) of the sentences of pairs (pair_id, clean_text, changed_text).

    equal: the same sentence, by occurrence; replaced: each other changed sentence with its most alike clean one, if their
    ratio (1 - edit distance / length) is above ``ALIGNED``; inserted and deleted: the rest, of which adjacent ones are put together as
    merged where that reads better (``_merged``). Only sentences of one pair meet. Pairs with at most ``compared`` pairs of sentences that have no equal
    are done in a row each; in larger ones sentences with a partner above ``ALIKE`` find it by rare grams, and only those that have none are
    compared with all other sentences of a fitting length, in blocks (``of_fitting_length``).
    """
    rows = _sentence_rows(pairs)
    equal = rows.where("side = 1 and other is not null").select("pair_id", F.col("other").alias("a"), F.col("pos").alias("b"), F.col("s").alias("clean"), F.col("s").alias("changed"), F.lit(1.0).alias("ratio"))
    few = F.col("pair_id").isNotNull() & (F.col("na") * F.col("nb") <= compared)
    left = rows.where("other is null")
    out = _rows(equal, "equal").unionByName(_in_row(left.where(few)))
    if not (large := left.where(~few)).isEmpty():
        out = out.unionByName(_over_tasks(large))
    return _merged(written(out))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"), F.lit(0))


def _lacking(old: pa.Array, new: pa.Array) -> pa.Array:
    """Of each changed token whether the clean tokens lack it, by occurrence."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (old, new)]
    words = pc.dictionary_encode(pa.concat_arrays([old.flatten(), new.flatten()]), null_encoding="encode")
    row = np.concatenate([np.repeat(np.arange(len(x)), x) for x in sizes])
    key = row * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")  # of a row's equal tokens the clean ones come first
    is_new = order >= sizes[0].sum()
    first = np.diff(key[order], prepend=-1) > 0
    begin, group = np.flatnonzero(first), np.cumsum(first) - 1
    olds = np.bincount(group[~is_new], minlength=len(begin))[group]
    lacks = np.empty(len(key), dtype=bool)
    lacks[order] = np.arange(len(key)) - begin[group] >= 2 * olds
    ends = np.concatenate([[0], np.cumsum(sizes[1])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(lacks[sizes[0].sum() :]), mask=new.is_null())


def labelled_sentences(aligned: DataFrame) -> DataFrame:
    """(pair_id, sent, words, labels) of the sentences of ``label_tokens``: a row a sentence, with its tokens and their labels in order.

    A row of aligned has both of its sentences, so the labels need no shuffle; where they aren't used no Python runs.
    """
    rows = aligned.where("kind <> 'equal'").select("pair_id", "sent", tokens(F.col("clean")).alias("old"), tokens(F.col("changed")).alias("new"))
    rows = rows.withColumn("lacks", F.arrow_udf(_lacking, "array<boolean>")("old", "new"))
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_old"))
    labels = F.when(F.col("is_old"), F.array_repeat(F.lit("N"), F.size("old"))).otherwise(F.transform("lacks", lambda v: F.when(v, F.lit("V")).otherwise(F.lit("N"))))
    sent = F.when(F.col("is_old"), -F.col("sent") - 1).otherwise(F.col("sent"))
    return rows.select("pair_id", sent.alias("sent"), F.when(F.col("is_old"), F.col("old")).otherwise(F.col("new")).alias("words"), labels.alias("labels")).where("words is not null")


def label_tokens(aligned: DataFrame) -> DataFrame:
    """(pair_id, sent, pos, token, label) of changed sentences: V what the clean sentence lacks, by occurrence, else N.

    Sentences without a clean one are V throughout; clean sentences are added with N throughout. aligned: align_revisions'
    rows with ``sent``, a number of the row within its pair.
    """
    rows = labelled_sentences(aligned).select("pair_id", "sent", "labels", F.posexplode("words").alias("pos", "token"))
    return rows.select("pair_id", "sent", "pos", "token", F.get("labels", F.col("pos")).alias("label"))


def label_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def token_features(labelled: DataFrame, keys: tuple[str, ...] = ("pair_id", "sent")) -> DataFrame:
    """labelled (keys, pos, token) with lower, shape, is_alpha, is_digit, the neighbours and whether the sentence begins or ends.

    labelled may have a row a sentence (keys, words, labels), as ``labelled_sentences`` gives them: then a token's neighbours are in its own row,
    and nothing is shuffled.
    """
    if "words" in labelled.columns:
        rows = labelled.select("*", F.posexplode("words").alias("pos", "token"))
        near = [F.get("words", F.col("pos") + k).alias(c) for k, c in ((-1, "__before"), (1, "__after"))]
        labelled = rows.select(*[c for c in labelled.columns if c not in ("words", "labels")], "pos", "token", F.get("labels", F.col("pos")).alias("label"), *near)
    else:
        w = Window.partitionBy(*keys).orderBy("pos")
        labelled = labelled.withColumns({"__before": F.lag("token").over(w), "__after": F.lead("token").over(w)})
    before, after = F.col("__before"), F.col("__after")
    plain = F.col("token").rlike("^[a-z]+\\z")  # most tokens; the rest is dearer
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "\\p{Lu}", "X"), "\\p{Ll}", "x"), "\\p{Nd}", "d")
    shape = F.when(plain, F.repeat(F.lit("x"), F.length("token"))).otherwise(shape)
    return labelled.withColumns(
        {"lower": F.lower("token"), "shape": shape, "is_alpha": plain | F.col("token").rlike("^\\p{L}+$"), "is_digit": ~plain & F.col("token").rlike("^\\p{Nd}+$"), "previous": F.lower(before), "next": F.lower(after), "bos": before.isNull(), "eos": after.isNull()}
    ).drop("__before", "__after")


FEATURES = ["lower", "shape", "is_alpha", "is_digit", "previous", "next", "bos", "eos"]


def counted_features(features: DataFrame) -> DataFrame:
    """(label, FEATURES, n), written: equal rows of ``token_features`` as one, with their number."""
    return written(features.groupBy("label", *FEATURES).agg(F.count(F.lit(1)).alias("n")))


def fit_token_classifier(features: DataFrame, size: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """A logistic model of the labels V and N over hashed token features. model.write() saves, PipelineModel.load() loads.

    The model weighs a row of ``counted_features`` by its number, so it holds distinct rows only; their features are computed and hashed once.
    """
    data = counted_features(features.fillna("", ["previous", "next"]))
    steps = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=size, categoricalCols=["is_alpha", "is_digit", "bos", "eos"])]
    hashing = Pipeline(stages=steps).fit(data)
    vectors = written(hashing.transform(data).select("label", "n", "y", "features"))
    model = LogisticRegression(labelCol="y", featuresCol="features", weightCol="n", maxIter=rounds, regParam=0.001).fit(vectors)
    return PipelineModel([*hashing.stages, model])


def _predicted(model: PipelineModel) -> Column:
    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    return F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted")


def predict_tokens(model: PipelineModel, features: DataFrame) -> DataFrame:
    """features with ``predicted``."""
    return model.transform(features.fillna("", ["previous", "next"])).select(*features.columns, _predicted(model))


def predicted_in_training(model: PipelineModel) -> DataFrame:
    """(label, n, predicted) of the rows that a model has just been fitted on, whose features aren't computed again."""
    return model.stages[-1].summary.predictions.select("label", F.col("n").cast("long").alias("n"), _predicted(model))


def classification_report(rows: DataFrame, label: str = "label", predicted: str = "predicted", n: str | None = None) -> DataFrame:
    """(label, precision, recall, f1, support), and as label 'weighted' the means by support. n: a column that says how many rows a row stands for."""
    pairs = rows.groupBy(F.col(label).cast("string").alias("l"), F.col(predicted).cast("string").alias("p")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))
    own = pairs.groupBy(F.col("l").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("l") == F.col("p"), F.col("n"))), F.lit(0)).alias("hit"))
    said = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    r = own.join(said, "label", "left")
    precision, recall = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.try_divide("hit", "support")
    r = r.select("label", precision.alias("precision"), recall.alias("recall"), "support")
    r = r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))

    def mean(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)

    total = r.agg(F.lit("weighted").alias("label"), mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support"))
    return r.select("label", "precision", "recall", "f1", "support").unionByName(total)
