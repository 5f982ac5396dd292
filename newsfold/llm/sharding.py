"""Sharding by a k-d tree over document metadata, in built-in functions alone.

Equal texts are one unit with the metadata of their least doc_id. Only a unit of more bytes than an even shard is torn:
into pieces as large as a shard, and small pieces of what is left. Each node of the tree is cut at the weighted median
of its widest dimension (its range against the whole range) until a leaf is small enough. Large units, of which there
are few, are placed first: each on its side of their own median, or where there is room. The cut then shares out the small
units so that both sides come even. The median is exact: bytes are summed by bins of the dimension and the bin where half
is reached is cut into bins again, until it holds one value. All nodes of a level go through one job, and the driver sees
bins and large units (a bounded number, however many shards), never rows. Shards are uneven only where units that aren't
torn leave no even way.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import parts, ranked, small, written
from newsfold.llm.text import body, documents

DIMENSIONS = ("doc_id", "size", "source", "lang")
#: Bins of a node in one round, at most; the share of a shard above which a unit is large, at least; bins and large units
#: that the driver sees at once, about.
BINS, UNIT_SHARE, LARGE_ROWS = 512, 1 / 64, 200_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, key): size is the UTF-8 bytes and one; equal texts have one key."""
    t = body()
    kept = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), *kept, F.unhex(F.md5(t)).alias("key"))


def units(rows: DataFrame, target: float, buckets: int) -> tuple[DataFrame, DataFrame]:
    """rows with their unit's number in the group (``part``), and the units (key, part, w, the dimensions x0...)."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("each"))
    per, little = (F.greatest(F.lit(1), F.floor(F.lit(float(share)) / F.col("each"))) for share in (target, target * UNIT_SHARE))
    torn = written(groups.where((F.col("w") > target) & (F.col("copies") > 1)).select("key", per.alias("per"), little.alias("small"), F.floor(F.col("copies") / per).alias("pieces")))
    whole = rows.join(small(torn), "key", "left_anti").withColumn("part", F.lit(0))  # fewer are torn than there are shards
    dealt = ranked(rows.join(small(torn), "key"), ["key"], [F.col(c) for c in ("doc_id", "source", "lang")], buckets, "at")
    rest = F.col("at") - F.col("pieces") * F.col("per")
    part = F.when(rest < 0, F.floor(F.col("at") / F.col("per"))).otherwise(F.col("pieces") + F.floor(rest / F.col("small")))
    rows = whole.unionByName(dealt.withColumn("part", part.cast("int")).select(*whole.columns)) if torn.count() else whole
    first = F.min(F.struct("doc_id", "size", "source", "lang")).alias("m")
    grouped = rows.groupBy("key", "part").agg(F.sum("size").alias("w"), first)

    def coordinate(k: int, name: str) -> Column:
        """A number; a hash below its resolution makes it differ from one unit to the next."""
        at = F.col(f"m.{name}")
        at = at if name in ("doc_id", "size") else F.pmod(F.xxhash64(at), F.lit(1 << 20))
        return (F.coalesce(at.cast("double"), F.lit(0.0)) + F.pmod(F.xxhash64("key", "part", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)).alias(f"x{k}")

    return rows, grouped.select("key", "part", "w", *[coordinate(k, d) for k, d in enumerate(DIMENSIONS)])


def _by_node(values: dict[int, float | int], kind: str, node: Column) -> Column:
    """values[node], or null, from one literal over the nodes, read as an array while the plan is made."""
    held = json.dumps([values.get(n) for n in range(1, max(values, default=1) + 1)])
    return F.try_element_at(F.from_json(F.lit(held), f"array<{kind}>"), node)


def _node(cuts: dict[int, tuple[int, float]]) -> Column:
    """The node of a unit: from the root, left (2n) if the coordinate is at most the cut, else right (2n + 1)."""
    x = F.array(*[F.col(f"x{k}") for k in range(len(DIMENSIONS))])

    def down(n: Column, _) -> Column:
        k = _by_node({n_: k + 1 for n_, (k, _) in cuts.items()}, "int", n)
        right = F.element_at(x, k) > _by_node({n_: at for n_, (_, at) in cuts.items()}, "double", n)
        return F.when(k.isNull(), n).otherwise(2 * n + right.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(cuts).bit_length())), F.lit(1), down) if cuts else F.lit(1)


def _sides(large: list, k: int, goal: float, rest: float) -> tuple[list, list]:
    """The large units of a node dealt to its sides, which have room for goal and rest: by x{k} about their own median
    where that side has room, heavy ones first, else where there is more room."""
    before, half, left = 0, sum(u["w"] for u in large) * goal / max(goal + rest, 1e-9), set()
    for i in sorted(range(len(large)), key=lambda i: (large[i][f"x{k}"], large[i]["key"], large[i]["part"])):
        if before + large[i]["w"] / 2 <= half:
            left.add(i)
        before += large[i]["w"]
    room, sides = [goal, rest], ([], [])
    for i in sorted(range(len(large)), key=lambda i: (-large[i]["w"], large[i]["key"], large[i]["part"])):
        side = int(i not in left)
        if large[i]["w"] > room[side]:
            side = int(room[1] > room[0])
        room[side] -= large[i]["w"]
        sides[side].append(large[i])
    return sides


def kd_cuts(tree: DataFrame, large: list, leaves: int) -> tuple[dict[int, tuple[int, float]], dict[int, int], dict[int, list]]:
    """The cuts of a tree with so many leaves over small units, the shard number of each leaf's node, and the large
    units of each leaf's node."""
    share, cuts, whole, held = {1: leaves}, {}, None, {1: large}
    dims = range(len(DIMENSIONS))
    while any(k > 1 for n, k in share.items() if n not in cuts):
        open_ = {n: k for n, k in share.items() if n not in cuts and k > 1}
        bins_ = max(8, min(BINS, LARGE_ROWS // len(open_)))
        at = tree.withColumn("node", _node(cuts)).where(_by_node(open_, "int", F.col("node")).isNotNull())
        got = {r["node"]: r for r in at.groupBy("node").agg(F.sum("w").alias("w"), *[f(f"x{k}").alias(f"{f.__name__}{k}") for k in dims for f in (F.min, F.max)]).collect()}
        state = {}
        for n, leaves_ in open_.items():
            r, own = got.get(n), held.get(n, [])
            span = {k: [*([r[f"min{k}"], r[f"max{k}"]] if r else []), *(u[f"x{k}"] for u in own)] or [0.0] for k in dims}
            whole = whole or {k: max(max(span[k]) - min(span[k]), 1e-9) for k in dims}
            k = max(dims, key=lambda d: ((max(span[d]) - min(span[d])) / whole[d], -d))
            w = (r["w"] if r else 0) + sum(u["w"] for u in own)
            goal = w * (leaves_ // 2) / leaves_
            held[2 * n], held[2 * n + 1] = _sides(own, k, goal, w - goal)
            goal -= sum(u["w"] for u in held[2 * n])
            lo, hi = (r[f"min{k}"], r[f"max{k}"]) if r else (0.0, 0.0)
            # all at one place go where they come nearer; a goal below zero leaves them to the right
            state[n] = {"k": k, "lo": lo, "hi": hi if goal > 0 else lo, "below": 0, "goal": goal, "cut": lo if lo == hi and r and r["w"] < 2 * goal else lo - 1}
        while live := {n: s for n, s in state.items() if s["hi"] > s["lo"]}:
            k = _by_node({n: s["k"] + 1 for n, s in live.items()}, "int", F.col("node"))
            lo, hi = (_by_node({n: float(s[e]) for n, s in live.items()}, "double", F.col("node")) for e in ("lo", "hi"))
            x = F.try_element_at(F.array(*[F.col(f"x{d}") for d in dims]), k)
            bins = at.select("node", "w", x.alias("x"), lo.alias("lo"), hi.alias("hi")).where("x between lo and hi")
            bins = bins.withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins_), F.lit(bins_ - 1)).cast("int"))
            sums = defaultdict(list)
            for r in bins.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():  # LARGE_ROWS or 8 a node
                sums[r["node"]].append(r)
            for n, s in live.items():
                s["hi"] = s["lo"]
                for r in sorted(sums[n], key=lambda r: r["bin"]):
                    if s["below"] + r["w"] > s["goal"]:
                        s["lo"], s["hi"] = r["lo"], r["hi"]
                        if r["lo"] == r["hi"] and s["below"] + r["w"] - s["goal"] < s["goal"] - s["below"]:
                            s["cut"] = r["hi"]  # nearer with that unit than without
                        break
                    s["below"] += r["w"]
                    s["cut"] = r["hi"]
        for n, s in state.items():
            cuts[n] = (s["k"], s["cut"])
            share[2 * n], share[2 * n + 1] = open_[n] // 2, open_[n] - open_[n] // 2
    ends = sorted((n for n in share if n not in cuts), key=lambda n: f"{n:b}".ljust(64, "0"))
    return cuts, {n: i for i, n in enumerate(ends)}, {n: held.get(n, []) for n in ends}


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: shards of near-equal bytes, slots gapless from 0.

    shards, or as many as keep to target_bytes. Null text is empty; null lang, source and doc_id are metadata like any
    other; repeated rows are placed each, side by side. An empty table gives no rows.
    """
    rows = written(sized(docs))
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    n = shards or max(1, math.ceil((total or 0) / (target_bytes or 1)))
    target, buckets = (total or 0) / n, parts(docs.sparkSession, count)
    rows, grouped = units(rows, target, buckets)
    tree = written(grouped)
    is_large = F.col("w") > target * max(UNIT_SHARE, n / LARGE_ROWS)
    cuts, number, held = kd_cuts(tree.where(~is_large), tree.where(is_large).collect(), n)  # at most LARGE_ROWS are large
    name = _by_node(number, "int", F.col("node"))
    leaf = tree.where(~is_large).withColumn("node", _node(cuts)).select("key", "part", name.cast("int").alias("shard"))
    if any(held.values()):
        large = [(bytes(u["key"]), u["part"], number[node]) for node, own in held.items() for u in own]
        columns = [pa.array(x, t) for x, t in zip(zip(*large, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)]
        leaf = leaf.unionByName(docs.sparkSession.createDataFrame(pa.Table.from_arrays(columns, ["key", "part", "shard"])))
    placed = rows.join(leaf, ["key", "part"]).select("doc_id", "size", "text_crc32", "shard")
    return ranked(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], buckets, "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write docs (unique ids) as one folder a shard, in files of the slots' order ranges."""
    put = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    put.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10(spark, sf_dir: str) -> DataFrame:
    rows = shard(documents(spark, sf_dir), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
