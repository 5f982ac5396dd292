"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and some pairs of features have a table over coarser bins. The tables
are learnt by cyclic boosting: round by round each feature in turn gets a shallow tree on its bins, fitted to the
residuals of the logistic loss; then pairs that explain most of what is left get trees on two features. A score is the
sum of the bins' values, looked up for whole columns at once.

Null text is empty: it has a score like any other. Labels without a doc_id or quality are ignored, of several labels of
a document the largest counts. Without a label of either kind every score is the share of label 1 (0.5 without
labels). Repeated rows get equal scores. labels, lang, source and doc_id are not features.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import written
from newsfold.llm.text import body, documents, without

#: The model is fitted on at most so many labelled rows (those with the least hash of the id).
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 48, 12, 150, 60, 0.15, 4
THRESHOLD = 0.3
FEATURES = ("log_words", "distinct_share", "word_length", "symbol_share", "shout_share", "upper_share", "digit_share", "stops_per_word", "bars_per_word", "lines_per_word", "copied_lines")
SPACE = " \t\n\x0b\x0c\r"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, the features) of every row, from the whole text."""
    t = docs.select("doc_id", body().alias("t"))
    t = t.select("doc_id", "t", F.filter(F.split("t", "[ \\t-\\r]+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x != "").alias("l"), F.length("t").cast("double").alias("n"))

    def share(chars: str) -> Column:
        return _ratio(F.col("n") - F.length(F.translate("t", chars, "")), F.col("n"))

    n = F.size("w").cast("double")
    return t.select(
        "doc_id",
        F.log1p(n).alias("log_words"),
        F.coalesce(F.try_divide(F.size(F.array_distinct("w")).cast("double"), n), F.lit(1.0)).alias("distinct_share"),
        _ratio(F.length(F.translate("t", SPACE, "")), n).alias("word_length"),
        share("#*$%&<>@^~=+_{}[]\\").alias("symbol_share"),
        share("!").alias("shout_share"),
        _ratio(F.col("n") - F.length(F.regexp_replace("t", "\\p{Lu}", "")), F.col("n")).alias("upper_share"),
        share("0123456789").alias("digit_share"),
        _ratio(F.col("n") - F.length(F.translate("t", ".,;:?", "")), n).alias("stops_per_word"),
        _ratio(F.col("n") - F.length(F.translate("t", "|", "")), n).alias("bars_per_word"),
        _ratio(F.size("l"), n).alias("lines_per_word"),
        _ratio(F.size("l") - F.size(F.array_distinct("l")), F.size("l")).alias("copied_lines"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


@dataclass
class Model:
    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.start)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            s += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, table in self.pairs:
            s += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree with a few leaves: the best cut of any leaf, again and again. g, h: sums by bin."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            if gain.max() > best:
                best, at = gain.max(), lo + 1 + int(gain.argmax())
        if at is None:
            break
        cuts = sorted([*cuts, at])
    return np.concatenate([np.full(hi - lo, _leaf(g[lo:hi].sum(), h[lo:hi].sum())) for lo, hi in zip(cuts, cuts[1:], strict=False)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the values by cell of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    top, toph, lf, lfh, tot, toth = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1], cg[-1, -1], ch[-1, -1]
    four = ((a, ah), (top - a, toph - ah), (lf - a, lfh - ah), (tot - top - lf + a, toth - toph - lfh + ah))
    gain = sum(x**2 / (y + 1) for x, y in four)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for k, s in enumerate((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[s] = _leaf(four[k][0][i, j], four[k][1][i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of these rows (a bounded sample)."""
    mean = y.mean() if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        return Model(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    k = x.shape[1]
    m = Model(float(np.log(mean / (1 - mean))), [_edges(x[:, i], BINS) for i in range(k)], pair_edges=[_edges(x[:, i], PAIR_BINS) for i in range(k)])
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    s = np.full(len(y), m.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(k):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[i], g, len(m.tables[i])), np.bincount(at[i], h, len(m.tables[i])))
            m.tables[i] += step
            s += step[at[i]]
    wide = [len(e) + 1 for e in m.pair_edges]
    coarse = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(m.pair_edges)]
    cell = {(i, j): coarse[i] * wide[j] + coarse[j] for i, j in combinations(range(k), 2)}

    def grid(ij: tuple[int, int], v: np.ndarray) -> np.ndarray:
        i, j = ij
        return np.bincount(cell[ij], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, h = slopes()
    chosen = sorted(cell, key=lambda ij: -_quadrants(grid(ij, g), grid(ij, h))[0])[:PAIRS]
    tables = {ij: np.zeros((wide[ij[0]], wide[ij[1]])) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for ij in chosen:
            g, h = slopes()
            step = RATE * _quadrants(grid(ij, g), grid(ij, h))[1]
            tables[ij] += step
            s += step.ravel()[cell[ij]]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


def held_out() -> Column:
    """Whether a row's label is never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """The model of feature rows with labels (doc_id, quality), held-out rows aside; of an id with several texts the row of least features counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    least = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "quality")).alias("r"))
    got = least.select("r.*", "doc_id").toPandas().sort_values("doc_id")  # max_rows rows
    return fit(got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy(float))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of feature rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # lookup tables: a few kB

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", *FEATURES).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, by a model fitted to its labelled rows."""
    rows = written(features(docs))
    out = scored(rows, train(rows, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects.

    Rows that repeat a doc_id go only if each of them would; rows with a null id stay.
    """
    best = classify(docs, labels).where("doc_id is not null").groupBy("doc_id").agg(F.max("predicted").alias("best"))
    return without(docs, written(best.where("best = 0").select("doc_id")))


def op4(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
