"""How filters interact: what each removes in every order, with duplicates found in radix tries.

Five conditions, A to E, fail a document; A to D are read off its text and E says that a row with a smaller doc_id has
the same text. For E, texts are dealt to tasks by ranges of a prefix that is as long as their number asks: short ones, longer
where many bytes share a short one, and where even a long one is shared by too many, texts are dealt by their hash. Each task inserts its
whole texts into a compressed trie that holds the least id at every terminal; walking the trie gives the rows that are
first of their text, and all others fail E. Before texts travel, each task drops those that it has sent on with a smaller id, so a
text that a third of the rows share is sent once a task.

Of each document there remains a mask of the conditions that it fails. Masks are counted by part, 32 numbers at most, and everything about the 120 orders
follows from these counts.

Null text is empty. Rows with a null doc_id don't fail E and fail nobody else. Rows that repeat a doc_id with one text are first
together. A null source is the part ''. Of several labels of one id any 1 counts. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import parts, small, written
from newsfold.llm.text import body, documents

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
CAPITALS, SYMBOLS = bytes(range(65, 91)), frozenset(b"#$%&*|")
#: Characters of the short and the long prefix; bytes of texts in a trie, about; texts that a task remembers to have sent.
SHORT, LONG = 8, 64
TRIE_BYTES, SENT = 32 << 20, 200_000


def mask_of(text: bytes) -> int:
    """The conditions A to D that a text in UTF-8 fails, as bits."""
    words = text.split()  # bytes are split at \x20 and \x09-\x0D alone
    n, capitals, chars = len(words), len(text) - len(text.translate(None, CAPITALS)), len(text.decode())
    return (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * chars) << 2 | (not SYMBOLS.isdisjoint(text)) << 3


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h, size, start) of every row: the mask of A to D, a hash of the text, its bytes and long prefix."""
    names = [("mask", pa.int32()), ("h", pa.int64()), ("size", pa.int64())]

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            columns = [[mask_of(t) for t in texts], [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], [len(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *[pa.array(c, k) for c, (_, k) in zip(columns, names, strict=True)], batch.column("start")], ["doc_id", "part", *[n for n, _ in names], "start"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text", body().substr(1, LONG).alias("start"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, h long, size long, start string")


class Trie:
    """A compressed trie of byte strings: a node is [edges by first byte, entry or None], an edge [label, node], an entry (least id, tag)."""

    def __init__(self):
        self.root: list = [{}, None]

    def insert(self, text: bytes, id_: int, tag: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                node[0][text[at]] = [text[at:], [{}, (id_, tag)]]
                return
            label = edge[0]
            if not text.startswith(label, at):
                k = _shared(label, text, at)
                edge[:] = [label[:k], [{label[k]: [label[k:], edge[1]]}, None]]
            node, at = edge[1], at + len(edge[0])
        if node[1] is None or id_ < node[1][0]:
            node[1] = (id_, tag)

    def entries(self):
        """The entries of all terminals."""
        open_ = [self.root]
        while open_:
            edges, entry = open_.pop()
            if entry is not None:
                yield entry
            open_ += [node for _, node in edges.values()]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many first bytes of label stand in text at a place; fewer than all do."""
    low, high = 0, len(label)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if text.startswith(label[low:mid], at + low) else (low, mid)
    return low


def prefixes(rows: DataFrame, tries: int) -> tuple[DataFrame, DataFrame]:
    """(short) and (long, tasks): the prefixes that hold more than half of an even share of the bytes of different texts.

    There are twice as many as tries at most. rows: of ``measured``, a written table.
    """
    texts = written(rows.groupBy("start", "h").agg(F.max("size").alias("size")))
    share = (texts.agg(F.sum("size")).first()[0] or 0) / (2 * tries)
    heavy = texts.groupBy(F.substring("start", 1, SHORT).alias("short")).agg(F.sum("size").alias("size")).where(F.col("size") > share).select("short")
    longer = texts.groupBy("start").agg(F.sum("size").alias("size")).where(F.col("size") > share).select(F.col("start").alias("long"), F.ceil(F.col("size") / share).cast("int").alias("tasks"))
    return written(heavy), written(longer)


def firsts(docs: DataFrame, rows: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(first_id, h), written: of every text the least doc_id and the hash of ``measured``. rows: measured(docs), written."""
    spark = docs.sparkSession
    tries = max(parts(spark, 0), -(-(rows.agg(F.sum("size")).first()[0] or 0) // trie_bytes))
    short, long = prefixes(rows, tries)

    def unsent(batches):
        """The rows but for texts that this task has sent on with an id as small."""
        sent: dict[bytes, int] = {}
        for batch in batches:
            hashes, keep = [], []
            for k, (i, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                d = xxhash.xxh3_128_digest(t.as_py())
                if d not in sent or i < sent[d]:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent[d] = i
                    keep.append(k)
                    hashes.append(xxhash.xxh3_64_intdigest(t.as_py()) - (1 << 63))
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(hashes, pa.int64())], ["doc_id", "text", "h"])

    def build(batches):
        trie = Trie()
        for batch in batches:
            for i, t, h in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("h").to_pylist(), strict=True):
                trie.insert(t.as_py().encode(), i, h)
        found = list(trie.entries())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], ["first_id", "h"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(unsent, "doc_id long, text string, h long")
    texts = texts.withColumns({"__short": F.substring("text", 1, SHORT), "__long": F.substring("text", 1, LONG)})
    texts = texts.join(small(short.select(F.col("short").alias("__short"), F.lit(True).alias("__many"))), "__short", "left").join(small(long.select(F.col("long").alias("__long"), "tasks")), "__long", "left")
    prefix = F.when(F.col("__many"), F.col("__long")).otherwise(F.col("__short")).alias("prefix")
    dealt = texts.select("doc_id", "text", "h", prefix, F.coalesce(F.pmod("h", F.col("tasks")), F.lit(0)).alias("deal"))
    return written(dealt.repartitionByRange(tries, "prefix", "deal").select("doc_id", "text", "h").mapInArrow(build, "first_id long, h long"))


def masks(docs: DataFrame, labels: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the conditions that they fail, and those that the labels mark."""
    rows = written(measured(docs))
    first = firsts(docs, rows, trie_bytes).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("marked_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = rows.select("doc_id", "part", "mask", "h").join(first.withColumnRenamed("h", "first_h"), (F.col("doc_id") == F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    found = found.join(marks, F.col("doc_id") == F.col("marked_id"), "left")
    fails_e = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(fails_e, 16).otherwise(0)).alias("mask")
    return found.groupBy("part", mask).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step."""
    counts = masks(docs, labels, trie_bytes).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 a part at most
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    rows = counts.select("part", "masks", F.explode(F.array(*steps)).alias("s")).select("part", "masks", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(of, value=lambda x: x["n"]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda n, x: n + F.when(of(x["mask"]), value(x)).otherwise(0).cast("long"))

    def fails(m):
        return m.bitwiseAND(bit) != 0

    def seen(m):
        return m.bitwiseAND(before) != 0

    def here(m):
        return fails(m) & ~seen(m)

    # of a mask's conditions each comes first in as many orders as another
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & seen(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"), total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
with recursive t as (
  select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (
  select *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') as w from t),
l as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
d as (
  select r, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by t), false) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from w left join l using (doc_id)),
orders as (
  select '' as o union all select o || f from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(o, f)),
steps as (
  select o as filter_order, s as step, o[s] as f, left(o, s - 1) as before from orders, (select unnest([1, 2, 3, 4, 5]) as s) where length(o) = 5),
fails as (
  select part, good, toxic, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as fs, count(*) as n
  from d group by all),
x as (
  select part, filter_order, step, f, n, good, toxic, contains(fs, f) as here, length(fs) = 1 as alone,
    len(list_filter(string_split(before, ''), lambda y: y <> '' and contains(fs, y))) > 0 as gone
  from fails, steps),
g as (
  select part, filter_order, step, f, coalesce(sum(n) filter (where not here and not gone), 0)::bigint as kept, coalesce(sum(n) filter (where here and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (where here and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where here and alone), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (where here and not gone and good = 1), 0)::bigint as good_lost, coalesce(sum(n) filter (where here and not gone and toxic = 1), 0)::bigint as toxic_lost
  from x group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from g
"""
