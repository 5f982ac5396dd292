"""Titles of a group as vectors: similarity, ranks, clusters, quorum, terms. Pairs are only formed inside a group."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold.functions.graph import connected_components
from newsfold.functions.runtime import free_name, parts, small, written
from newsfold.functions.vectors import cosine, dot, norm

#: Shares of a group's titles that make a supermajority and a consensus; 1 is unanimous.
SUPERMAJORITY, CONSENSUS = 2 / 3, 1 / 2
#: English function words that terms leave out.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both
    but by can could did do does doing down during each few for from further had has have having he her here hers him his
    how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own
    same she should so some such than that the their theirs them then there these they this those through to too under
    until up very was we were what when where which while who whom why will with would you your yours""".split()
)


#: Titles of a group that are paired at most; an article has some ten.
PAIRED = 5_000
#: Characters of the texts of which one task holds the terms, about.
PART_CHARS = 8_000_000


def unit_vectors(titles: DataFrame) -> DataFrame:
    """(grp, id, u): the titles with vectors of unit length; null and zero vectors have none."""
    rows = titles.select("grp", "id", "embedding", norm(F.col("embedding")).alias("__n")).where("__n > 0")
    return rows.select("grp", "id", F.transform("embedding", lambda x: x / F.col("__n")).alias("u"))


def pairwise_similarity(titles: DataFrame, most: int = PAIRED) -> DataFrame:
    """(grp, a, b, sim) of the pairs of each group of titles (grp, id, embedding), a < b.

    Vectors are made unit length once. A group is meant to hold an article's titles, as its pairs are all made: one with more than
    ``most`` is an error. ``eps_components`` links groups of any size.
    """
    n, told = F.count(F.lit(1)), F.concat(F.lit("too many titles to pair in group "), F.coalesce(F.col("grp").cast("string"), F.lit("null")))
    fits = titles.groupBy("grp").agg(n.alias("__n")).where(F.when(F.col("__n") > most, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).select("grp")
    unit = unit_vectors(titles).join(fits, "grp")
    a, b = unit.select("grp", F.col("id").alias("a"), F.col("u").alias("ua")), unit.select(F.col("grp").alias("g"), F.col("id").alias("b"), F.col("u").alias("ub"))
    return a.join(b, (F.col("grp") == F.col("g")) & (F.col("a") < F.col("b"))).select("grp", "a", "b", dot(F.col("ua"), F.col("ub")).alias("sim"))


def group_cohesion(titles: DataFrame) -> DataFrame:
    """(grp, n, cohesion): the mean similarity of a group's pairs; null for one title.

    The sum over pairs is (|sum of unit vectors|^2 - n) / 2, so no pair is made.
    """
    unit = titles.select("grp", "id", F.posexplode(F.transform("embedding", lambda x: x / norm(F.col("embedding")))).alias("pos", "x"))
    sums = unit.groupBy("grp", "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy("grp").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return whole.select("grp", "n", F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("cohesion"))


def centroids(titles: DataFrame) -> DataFrame:
    """(grp, centroid)."""
    each = titles.select("grp", F.posexplode("embedding").alias("pos", "x"))
    mean = each.groupBy("grp", "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("grp", F.col("c.x").alias("centroid"))


def rank_by_centroid(titles: DataFrame) -> DataFrame:
    """(grp, id, sim, rank): titles by their similarity to the group's centroid."""
    rows = titles.join(centroids(titles), "grp").select("grp", "id", cosine(F.col("embedding"), F.col("centroid")).alias("sim"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("sim", 9)), "id")))


def article_similarity(titles: DataFrame, articles: DataFrame) -> DataFrame:
    """(grp, id, sim, mean_sim): each title against its article's vector (grp, article), and the group's mean."""
    rows = titles.join(articles, "grp").select("grp", "id", cosine(F.col("embedding"), F.col("article")).alias("sim"))
    return rows.withColumn("mean_sim", F.avg("sim").over(Window.partitionBy("grp")))


def kmeans_scan(titles: DataFrame, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """(k, cost, silhouette, best_silhouette, elbow): k-means for each k, with the two choices marked.

    The elbow is the k farthest below the line from the first to the last cost.
    """
    data = titles.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    judge = ClusteringEvaluator()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(data)
        rows.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(data)))))
    data.unpersist()
    out = titles.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")
    (k0, c0), (k1, c1) = (rows[0][:2], rows[-1][:2])
    elbow = max(rows, key=lambda r: c0 + (c1 - c0) * (r[0] - k0) / max(k1 - k0, 1) - r[1])[0]
    best = max(rows, key=lambda r: r[2])[0]
    return out.withColumn("best_silhouette", F.col("k") == best).withColumn("elbow", F.col("k") == elbow)


#: Titles of a group that is linked by all of its pairs; pivots of a larger one, about; vectors of a block's side, about.
FEW, PIVOTS, CHUNK = 200, 16, 2_000
#: What an angle may be off by rounding.
SLIP = 1e-6


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that hold together what a matrix of links holds together: a tree for each part of it."""
    left, out = set(range(near.shape[0])), []
    free = np.ones(near.shape[1], bool)
    while left:
        open_ = [left.pop()]
        while open_:
            i = open_.pop()
            found = np.flatnonzero(near[i] & free)
            free[found] = False
            out += [(i, int(j)) for j in found]
            if found.size:
                ways = near[:, found].any(axis=1)
                for k in [k for k in np.flatnonzero(ways) if k in left]:
                    left.discard(k)
                    open_.append(int(k))
                    out.append((int(k), int(found[near[k, found].argmax()])))
    return out


def _links_of_large(rows: DataFrame, eps: float, pivots: int, chunk: int) -> DataFrame:
    """(a, b): links of large groups' vectors (grp, n, id, u), enough to hold every component together.

    About ``pivots`` vectors of each group, by a hash of the id, are its pivots. A vector is at home in the cell of its nearest pivot, and
    lies in the cell of every pivot that is at most its least angle and twice theta away: by the triangle inequality that is where its
    partners, theta away at most, are at home. Vectors within half of theta of a pivot are its core and all linked, by links to the
    pivot alone; what else lies in a cell is compared with what is at home there, in blocks of chunks, and a block gives a forest of
    its links. So a tight crowd costs a link a vector, and the rows made never grow with the square of a group.
    """
    theta, h = math.acos(max(-1.0, 1 - eps)), F.xxhash64("id")
    chosen = rows.where(F.pmod(h, F.col("n")) < pivots).groupBy("grp").agg(F.collect_list(F.struct("id", "u")).alias("p"))
    angles = F.transform(F.coalesce("p", F.array().cast("array<struct<id:bigint,u:array<double>>>")), lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("u"), p["u"])))))
    d = rows.join(small(written(chosen)), "grp", "left").select("grp", "id", "u", F.transform("p", lambda p: p["id"]).alias("p"), angles.alias("ang"))
    d = d.withColumn("least", F.coalesce(F.array_min("ang"), F.lit(math.pi)))
    cell = F.when(F.size("ang") == 0, F.array(F.struct(F.lit(0).alias("cell"), F.lit(math.pi).alias("ang"), F.col("id").alias("pivot")))).otherwise(
        F.filter(F.transform("ang", lambda x, i: F.struct(i.alias("cell"), x.alias("ang"), F.get("p", i).alias("pivot"))), lambda c: c["ang"] <= F.col("least") + 2 * theta + SLIP)
    )
    home = F.when(F.size("ang") == 0, 0).otherwise(F.array_position("ang", F.col("least")) - 1)
    placed = written(d.select("grp", "id", "u", home.alias("home"), F.explode(cell).alias("c")).select("grp", "id", "u", (F.col("home") == F.col("c.cell")).alias("own"), "c.*").withColumn("core", F.col("ang") <= theta / 2 - SLIP))
    to_pivot = placed.where((F.col("ang") <= theta - SLIP) & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b"))

    def chunks(test: Column) -> Column:
        return F.ceil(F.count_if(test) / chunk).cast("int")

    counts = placed.groupBy("grp", "cell").agg(chunks(~F.col("core")).alias("ls"), chunks(F.col("own")).alias("rs")).where("ls > 0 and rs > 0")
    rows = placed.join(small(written(counts)), ["grp", "cell"])
    left = rows.where("not core").select("grp", "cell", F.pmod(h, "ls").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("j"), F.lit(True).alias("is_left"), "id", "u")
    right = rows.where("own").select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("ls") - 1)).alias("i"), F.pmod(h, "rs").cast("int").alias("j"), F.lit(False).alias("is_left"), "id", "u")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["is_left"] == side] for side in (True, False))
        if x.empty or y.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        a, b = x["id"].to_numpy(), y["id"].to_numpy()
        near = 1 - np.stack(x["u"].to_numpy()) @ np.stack(y["u"].to_numpy()).T <= eps
        found = [(a[i], b[j]) for i, j in _forest(near) if a[i] != b[j]]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return to_pivot.unionByName(left.unionByName(right).groupBy("grp", "cell", "i", "j").applyInPandas(link, "a long, b long"))


def eps_components(titles: DataFrame, eps: float = 0.2, few: int = FEW, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(grp, id, cluster): groups' titles linked at a cosine distance of eps or less; alone: -1. Ids are whole numbers, unique over all groups.

    With two as the least size of a neighbourhood this is density clustering. A cluster is named by its least id. Groups of up to
    ``few`` titles are linked by their pairs, larger ones cell by cell around pivots (``_links_of_large``).
    """
    sizes = written(titles.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.where(F.col("n") > few)
    links = pairwise_similarity(titles.join(sizes.where(F.col("n") <= few).select("grp"), "grp")).where(1 - F.col("sim") <= eps).select("a", "b")
    if not large.isEmpty():
        rows = written(unit_vectors(titles).join(large, "grp").select("grp", "n", F.col("id").cast("long").alias("id"), "u"))
        links = links.unionByName(_links_of_large(rows, eps, pivots, chunk))
    roots = connected_components(links)
    named = roots.groupBy("root").agg(F.min("node").alias("cluster"))
    found = roots.join(named, "root").select(F.col("node").alias("id"), "cluster")
    return titles.select("grp", "id").join(found, "id", "left").select("grp", "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def title_quorum(clusters: DataFrame) -> DataFrame:
    """(grp, cluster, share, label): each group's largest cluster, the lowest of equals, and how far it agrees."""
    n = clusters.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("grp").agg(F.sum("n").alias("all"), F.max(F.when(F.col("cluster") != -1, F.struct("n", (-F.col("cluster")).alias("c")))).alias("b"))
    share = F.coalesce(F.col("b.n") / F.col("all"), F.lit(0.0))
    label = F.when(share == 1, "unanimous").when(share >= SUPERMAJORITY, "supermajority").when(share > CONSENSUS, "consensus")
    return best.select("grp", (-F.col("b.c")).alias("cluster"), share.alias("share"), label.alias("label"))


def _terms(words: str) -> list[str]:
    """The words between single spaces, and the pairs of neighbours."""
    w = words.split(" ")
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def _rows_of_keys(keys: pa.ChunkedArray) -> list[list[int]]:
    """The rows of each key."""
    found: dict = {}
    for i, k in enumerate(keys.to_pylist()):
        found.setdefault(k, []).append(i)
    return list(found.values())


def tfidf_top_terms(docs: DataFrame, key: str = "doc_id", n: int = 10) -> DataFrame:
    """(key, term, weight, rank): words and word pairs without English stop words, smooth idf, unit length per document.

    Documents are dealt to parts of some ``PART_CHARS`` characters. A part counts the documents of each of its terms, so a term is sent once a
    part and not once a document; the sums over all parts go back to the part, which weighs its documents with them.
    """
    part, found = free_name(docs, "__part"), F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))
    words = F.filter(found, lambda w: ~w.isin(*STOP_WORDS))
    total, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    dealt = F.pmod(F.xxhash64(key), F.lit(parts(docs.sparkSession, chars, PART_CHARS))).cast("int").alias(part)
    rows = docs.select(dealt, key, words.alias("w")).where(F.size("w") > 0).select(part, key, F.array_join("w", " ").alias("w"))

    def counted(t: pa.Table) -> pa.Table:
        held: Counter = Counter()
        texts = t["w"].to_pylist()
        for own in _rows_of_keys(t[key]):
            held.update({term for i in own for term in _terms(texts[i])})
        return pa.table({part: pa.array([t[part][0].as_py()] * len(held), "int32"), "term": pa.array(list(held.keys()), "string"), "df": pa.array(list(held.values()), "int64")})

    def weighed(t: pa.Table, df: pa.Table) -> pa.Table:
        idf = dict(zip(df["term"].to_pylist(), df["idf"].to_pylist(), strict=True))
        texts, first, top = t["w"].to_pylist(), [], []
        for own in _rows_of_keys(t[key]):
            tf = Counter(term for i in own for term in _terms(texts[i]))
            x = np.fromiter(tf.values(), "float64", len(tf)) * np.fromiter(map(idf.__getitem__, tf), "float64", len(tf))
            weight = np.round(x / math.sqrt(x @ x), 9)
            least = np.partition(weight, -n)[-n] if len(weight) > n else -math.inf
            best = heapq.nsmallest(n, ((-w, term) for w, term in zip(weight.tolist(), tf, strict=True) if w >= least))
            first += [own[0]] * len(best)
            top += [(term, -w, i + 1) for i, (w, term) in enumerate(best)]
        term, weight, rank = zip(*top, strict=True) if top else ((), (), ())
        return pa.table({key: t[key].take(pa.array(first, "int64")), "term": pa.array(term, "string"), "weight": pa.array(weight, "float64"), "rank": pa.array(rank, "int32")})

    own = rows.groupBy(part).applyInArrow(counted, f"{part} int, term string, df long")
    df = F.sum("df").over(Window.partitionBy("term"))  # a row a part at most
    idf = own.select(part, "term", (F.ln((1 + F.lit(total)) / (1 + df)) + 1).alias("idf"))
    schema = T.StructType([docs.schema[key]]).add("term", "string").add("weight", "double").add("rank", "integer")
    return rows.groupBy(part).cogroup(idf.groupBy(part)).applyInArrow(weighed, schema)


def entity_jaccard(titles: DataFrame) -> DataFrame:
    """titles (grp, id, entities, article_entities) with the share of common entities, those, and the rank in the group."""
    common = F.array_intersect("entities", "article_entities")
    share = F.try_divide(F.size(common), F.size(F.array_union("entities", "article_entities")))
    rows = titles.withColumn("jaccard", share).withColumn("common", common)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("jaccard"), "id")))
