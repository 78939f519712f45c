"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting.

Each feature is cut into bins; round after round, each feature in turn gets a shallow tree on the current residuals,
and the trees of a feature add up to one number per bin. Then the feature pairs with most left to explain get shallow
trees over their two-way tables in the same manner. A score is the sum of an intercept and one table entry per feature
and pair, so scoring is indexing and adding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import small_batches, text_of
from firnline.llm.text_features import NAMES, features

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Labelled rows that the model is fitted on, at most about so many: what the driver holds does not grow with the corpus.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
PAIRS = 8
LEAST_ROWS, PENALTY = 5.0, 1.0
THRESHOLD = 0.7


@dataclass
class Gam:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        if self.pairs:
            used = {k for pair in self.pairs for k in pair}
            cells = {k: np.searchsorted(self.coarse[k], x[:, k], "right") for k in used}
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[cells[a], cells[b]]
        return _probability(total)


def _probability(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step for each bin: a tree of at most 2^depth leaves over the ordered bins, from sums of gradients."""
    step = np.full(len(g), g.sum() / (h.sum() + PENALTY))
    if depth == 0 or len(g) < 2:
        return step
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1:], ch[-1:])
    gain[(cn[:-1] < LEAST_ROWS) | (cn[-1] - cn[:-1] < LEAST_ROWS)] = 0
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= 1e-9:
        return step
    return np.concatenate([shallow_tree(g[:at], h[:at], n[:at], depth - 1), shallow_tree(g[at:], h[at:], n[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The step for each cell of a two-way table, and its gain: one cut of the first feature, one of the second on each side."""
    best, best_gain = np.zeros_like(g), 0.0
    for flip in (False, True):
        gg, hh, nn = (t.T if flip else t for t in (g, h, n))
        for cut in range(1, len(gg)):
            step, gain = np.zeros_like(gg), -float(_gain(gg.sum(), hh.sum()))
            for rows in (slice(None, cut), slice(cut, None)):
                rg, rh, rn = gg[rows].sum(0), hh[rows].sum(0), nn[rows].sum(0)
                own = shallow_tree(rg, rh, rn, 1)
                gain += float((2 * own * rg - own * own * rh).sum())  # how much the squared loss falls
                step[rows] = own
            if gain > best_gain:
                best, best_gain = (step.T if flip else step), gain
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model for features x and labels y (0 or 1). Without rows every score is 0.5; one class gives a constant."""
    width = x.shape[1] if x.ndim == 2 else len(NAMES)
    if not len(y):
        return Gam([np.empty(0)] * width, [np.empty(0)] * width, 0.0, [np.zeros(1)] * width, [], [])
    edges, coarse = [_cuts(x[:, k], BINS) for k in range(width)], [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), intercept)
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    for _ in range(ROUNDS):
        for k in range(width):
            p = _probability(total)
            step = RATE * shallow_tree(np.bincount(bins[k], y - p, len(tables[k])), np.bincount(bins[k], p * (1 - p), len(tables[k])), rows[k])
            tables[k] += step
            total += step[bins[k]]

    def table_of(a: int, b: int, weights: np.ndarray | None) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(cells[a] * shape[1] + cells[b], weights, shape[0] * shape[1]).reshape(shape).astype(float)

    p = _probability(total)
    gains = {(a, b): pair_tree(table_of(a, b, y - p), table_of(a, b, p * (1 - p)), table_of(a, b, None))[1] for a, b in combinations(range(width), 2)}
    pairs = [pair for pair in sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS] if gains[pair] > 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(pairs):
            p = _probability(total)
            step = RATE * pair_tree(table_of(a, b, y - p), table_of(a, b, p * (1 - p)), table_of(a, b, None))[0]
            pair_tables[i] += step
            total += step[cells[a], cells[b]]
    return Gam(edges, coarse, intercept, tables, pairs, pair_tables)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept for testing: crc32 of the doc_id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def feature_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns of `keep` and an array of the features of text."""
    small_batches(docs.sparkSession)
    columns = docs.select(*keep, text_of().alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.dtypes if c != "text") + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "features"])

    return columns.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """Fit on labelled rows that are not held out: all of them, or about sample_rows chosen by a hash of doc_id.

    Rows without a label of 0 or 1 are no examples. The chosen ids are few enough to be broadcast to the documents.
    """
    known = labels.where(F.col("quality").isin(0, 1)).where(~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    chosen = F.broadcast(known).alias("k")
    examples = docs.select("doc_id", "text").alias("d").join(chosen, F.col("d.doc_id") == F.col("k._id")).select("k._id", "k.quality", "d.text")
    found = feature_rows(examples, ("_id", "quality")).orderBy("_id").toPandas()
    if not len(found):
        return fit(np.empty((0, len(NAMES))), np.empty(0))
    return fit(np.stack(found["features"].to_numpy()), found["quality"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from `threshold` on).

    Only text goes into a score; null counts as empty. Repeated rows give repeated rows; other columns are not read.
    """
    model = learn(docs, labels, sample_rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def good_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    model = learn(docs, labels, sample_rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            good = model.score(features(pc.fill_null(batch.column("text"), ""))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
