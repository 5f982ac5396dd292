"""SimHash near-dedup by the generalised pigeonhole principle.

If two fingerprints differ in at most tau bits and the 64 bits are dealt to m partitions with thresholds t_1..t_m that
sum to tau - m + 1 (-1: the partition isn't used), then some partition i differs in at most t_i bits. So each fingerprint
is filed in every partition under its own value and under all values within t_i bits; fingerprints that meet in a
bucket are compared in full.

Correlated bits are put into one partition, so that the others stay selective. Thresholds and the number of partitions
come from a dynamic program over the estimated number of rows and candidates; the estimates use bit statistics and
collision counts of all distinct fingerprints.

Buckets are read in sorted runs. A run gives the links of a spanning forest of its verified pairs and not all pairs, so
a group of k near copies costs k rows a bucket. Runs above ``BLOCK`` rows are dealt to pairs of blocks in tasks of their
own, which together still compare every pair.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.graph import connected_components
from newsfold.functions.runtime import parts, small, written
from newsfold.llm.text import documents, without

BITS, SEED = 64, 42
WORDS, TAU = 4, 4
#: Rows of one bucket that one task compares.
BLOCK = 8_192
#: The share of all fingerprints, and the least number, above which a component's rows aren't dealt by their root.
HOT_SHARE, HOT_LEAST = 1e-4, 1000
#: Words that are hashed at a time, so that a very long text needs no more memory.
CHUNK = 50_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned integer; no words: 0."""
    import xxhash

    w = (text or "").encode().lower().split()  # of bytes: lower-cases A-Z alone and splits at 0x20 and 0x09-0x0D
    if not w:
        return 0
    if len(w) < words:
        shingles, n = [b" ".join(w)], 1
    else:
        n = len(w) - words + 1
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    hashed, ones = (xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(hashed, np.uint64, min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 matrix of how many have both bits; a matrix a task is summed in Spark."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    got = dict(distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())  # 4097 rows at most
    return got.get(BITS * BITS, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of near-equal width, each grown from a bit by the one most correlated with it."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        own = [max(left, key=lambda b: (corr[b][left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (corr[b][own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def value(fp: Column, bits: list[int]) -> Column:
    """The bits of fp, side by side."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def within(n: int, both: np.ndarray, bits: list[int], collisions: int, tau: int) -> list[float]:
    """Pairs that differ in at most t of these bits, for t from 0 to tau.

    Bits count as independent, each differing by its share of ones; the result is scaled to the counted collisions.
    """
    p = both.diagonal() / max(n, 1)
    dist = np.zeros(len(bits) + 1)
    dist[0] = 1
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        dist[1:], dist[0] = dist[1:] * (1 - q) + dist[:-1] * q, dist[0] * (1 - q)
    up = np.cumsum(dist)[: tau + 1]
    scale = max(collisions, 1) / max(up[0], 1e-300)
    return [min(float(x) * scale, float(n) * n) for x in up]


def allocate(widths: list[int], pairs: list[list[float]], n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds of least cost (rows filed and pairs compared) that sum to tau - m + 1, by dynamic programming."""
    m = len(widths)
    best = {0: (0.0, [])}
    for width, near in zip(widths, pairs, strict=True):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, tau + 1):
                ball = sum(comb(width, k) for k in range(t + 1))
                # a row is sorted and sent, which costs as much as some 50 comparisons
                c = cost + (0 if t < 0 else 50.0 * n * ball + near[t] * ball)
                if used + t not in nxt or c < nxt[used + t][0]:
                    nxt[used + t] = (c, [*ts, t])
        best = nxt
    return best[tau - m + 1]


def plan(distinct: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The partitions (their bits and threshold) for these fingerprints."""
    n, both = bit_counts(distinct)
    options = {m: correlated_parts(n, both, m) for m in range(2, tau + 2)}
    filed = [(m, i, bits) for m, ps in options.items() for i, bits in enumerate(ps)]
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), value(F.col("fp"), bits).alias("v")) for m, i, bits in filed])).alias("x")
    counts = distinct.select(values).groupBy("x.m", "x.i", "x.v").count().groupBy("m", "i").agg(F.sum(F.col("count") * (F.col("count") - 1)))
    met = {(m, i): c for m, i, c in counts.collect()}  # 14 rows
    costs = {m: allocate([len(b) for b in ps], [within(n, both, b, met.get((m, i), 0), tau) for i, b in enumerate(ps)], n, tau) for m, ps in options.items()}
    m = min(costs, key=lambda k: costs[k][0])
    return [(bits, t) for bits, t in zip(options[m], costs[m][1], strict=True) if t >= 0]


def filed(distinct: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, v, fp): each fingerprint under its value and those near it, in each partition."""
    rows = []
    for part, (bits, t) in enumerate(partitions):
        masks = [sum(1 << k for k in ks) for r in range(t + 1) for ks in combinations(range(len(bits)), r)]
        v = F.explode(F.array(*[F.lit(x).cast("long") for x in masks])).alias("mask")
        at = distinct.select("fp", value(F.col("fp"), bits).alias("v"), v)
        rows.append(at.select(F.lit(part).alias("part"), F.col("v").bitwiseXOR(F.col("mask")).alias("v"), "fp"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _forest(fp: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """Places (a, b) of the links of a spanning forest of the pairs at most tau bits apart."""
    a, b = [], []
    left = np.arange(len(fp))
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= tau
            found, left = left[near], left[~near]
            queue.extend(found)
            a.extend([x] * len(found))
            b.extend(found)
    return a, b


def _links(tau: int, keys: list[str]):
    """Links of sorted rows of (keys, fp): pairs of short runs at once by offsets, long runs by a forest each."""
    short = 16

    def whole(key: np.ndarray, fp: np.ndarray):
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        length = np.diff(np.append(at, len(fp)))
        ends = np.repeat(at + length, length)
        ends[np.repeat(length > short, length)] = 0
        a, b = [], []
        for step in range(1, short):
            i = np.flatnonzero(np.arange(len(fp)) + step < ends)
            if not i.size:
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= tau]
            a.append(fp[i])
            b.append(fp[i + step])
        for s, n in zip(at[length > short], length[length > short], strict=True):
            x, y = _forest(fp[s : s + n], tau)
            a.append(fp[s : s + n][x])
            b.append(fp[s : s + n][y])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"])

    def run(batches):
        key, fp = np.zeros((0, len(keys)), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            other = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else []
            cut = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch; a run has few blocks of rows
            if cut:
                yield from whole(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(fp):
            yield from whole(key, fp)

    return run


def links(distinct: DataFrame, tau: int = TAU, partitions: list[tuple[list[int], int]] | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect the same fingerprints as all pairs at most tau bits apart."""
    rows = filed(distinct, partitions or plan(distinct, tau))
    hot = written(rows.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    nb = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    rows = rows.join(small(hot), ["part", "v"], "left").withColumn("nb", nb).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("part", "v", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp")
    keys = ["part", "v", "b1", "b2"]
    n = parts(distinct.sparkSession, 1)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_links(tau, keys), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, tau: int = TAU) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id that chains of links reach.

    A null or empty text has fingerprint zero and is linked like any other. Null ids take part and never name a
    component unless it has no other. Repeated rows give equal rows; empty tables give none; other columns are ignored.
    """
    rows = written(fingerprints(docs, words))
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = written(connected_components(links(groups.select("fp"), tau)))
    rooted = written(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    total = rooted.count()
    # components of so many fingerprints are at most 1 / HOT_SHARE, and their names go to all tasks; the others shuffle
    hot = F.broadcast(names.where(F.col("n") > max(HOT_LEAST, total * HOT_SHARE)).drop("n"))
    named = rooted.join(hot, "root").unionByName(rooted.join(hot, "root", "left_anti").join(names.drop("n"), "root"))
    return rows.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    Rows that repeat a doc_id go only if each of them would; rows with a null id stay.
    """
    stays = F.max(F.col("doc_id") == F.col("component_id")).alias("stays")
    near = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(stays)
    return without(docs, written(near.where("not stays").select("doc_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    near = near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
