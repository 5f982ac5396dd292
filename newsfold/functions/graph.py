"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of one component have one root.

    Each round maps a node to whichever of itself and its neighbours has the least hash, relabels the edges and drops
    those inside one node. Hashes stand in for random priorities, so a constant share of the nodes goes each round,
    chains and stars included. Minima are combined before the shuffle: a hub costs no more than another node. Null
    ends and loops are ignored.
    """
    e = written(_tidy(edges.select(F.col("a"), F.col("b"))))
    steps: list[DataFrame] = []
    while not e.isEmpty():
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("v")))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
        step = ends.groupBy("node").agg(best.alias("m")).select("node", F.least("m", own)["v"].alias("parent"))
        step = written(step)
        steps.append(step)
        a, b = (step.select(F.col("node").alias(k), F.col("parent").alias(f"p{k}")) for k in "ab")
        e = written(_tidy(e.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("parent").alias("root"))
    for step in steps[1:]:
        up = step.select(F.col("node").alias("root"), F.col("parent").alias("up"))
        out = out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
