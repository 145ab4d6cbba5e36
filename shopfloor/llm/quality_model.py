"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed once for every document and written. The trees are fitted with numpy on a bounded
sample of labelled rows (`Training.rows`, those with the smallest hash of the id), on features cut into at
most 255 bins; each split takes the best gain of the summed gradients of the bins. The fitted trees are
flat arrays (feature, threshold, leaf value), and scoring walks all rows of a batch down a tree at once.

Cases: null and empty texts have statistics of 0 and a score; a null id is never learnt from and not held
out; repeated labels of an id count once (the greatest); without labels of both kinds every score is the
mean label (0.5 without any); labels, lang, source and doc_id are no inputs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopfloor.llm.stats import text_stats
from shopfloor.llm.store import keep, table
from shopfloor.llm.text import lists, pieces


@dataclass(frozen=True)
class Training:
    rows: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    least_rows: int = 5
    l2: float = 1.0


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """rows x features; a ratio of nothing is 0."""
    over = lambda a, b: a / np.maximum(b, 1)
    words, chars = s["n_words"], s["word_chars"]
    return np.column_stack([
        np.log1p(words), np.log1p(s["n_bytes"]), over(chars, words), over(s["n_symbols"], words), over(s["n_dup_lines"], s["n_lines"]), over(s["n_repeat_words"], words),
        over(s["n_repeated"], words), over(s["n_upper"], s["n_letters"]), over(s["n_digits"], chars), over(s["n_punctuation"], words), over(s["n_bang"], words),
        over(s["n_bar"], words), over(s["n_wide"], s["n_bytes"]), over(s["n_sentences"], words), over(s["n_capital"], words), over(words, s["n_lines"]),
        np.log1p(s["longest_word"]), over(s["n_letters"] + s["n_wide"], s["n_bytes"]),
    ]).astype(np.float64)


@dataclass
class Trees:
    """Node i of a tree has the children 2 i + 1 (value <= threshold) and 2 i + 2; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, t: Training = Training()) -> Trees:
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    start, inner = float(np.log(mean / (1 - mean))), (1 << t.depth) - 1
    trees = 0 if len(y) == 0 or y.min() == y.max() else t.trees
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start, t.depth)
    if not trees:
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, t.bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])  # c <= edges[b] exactly where bin <= b
    total, k = np.full(len(y), start), x.shape[1]
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(t.depth):
            first, nodes = (1 << level) - 1, 1 << level
            at = (node - first) * t.bins
            hist = np.stack([np.stack([np.bincount(at + binned[:, f], w, nodes * t.bins) for w in (g, h, None)]) for f in range(k)])
            left = np.cumsum(hist.reshape(k, 3, nodes, t.bins), axis=3)
            whole = left[..., -1:]
            right = whole - left
            gain = left[:, 0] ** 2 / (left[:, 1] + t.l2) + right[:, 0] ** 2 / (right[:, 1] + t.l2) - whole[:, 0] ** 2 / (whole[:, 1] + t.l2)
            gain = np.where((left[:, 2] >= t.least_rows) & (right[:, 2] >= t.least_rows), gain, -1.0)
            for n in range(nodes):
                f, b = np.unravel_index(np.argmax(gain[:, n]), (k, t.bins))
                if gain[f, n, b] > 1e-9:
                    out.feature[tree, first + n], out.threshold[tree, first + n] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[tree, node]] > out.threshold[tree, node])
        leaf = node - inner
        out.leaf[tree] = -t.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + t.l2)
        total += out.leaf[tree][leaf]
    return out


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in pieces(batch.column("text")):
            x = features(text_stats(data, offsets))
            flat = lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), flat], ["doc_id", "features"])


def text_features(docs: DataFrame) -> DataFrame:
    return keep(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(feature_rows, "doc_id long, features array<double>"), "quality-features")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, t: Training = Training()) -> Trees:
    """`rows` has doc_id and features. At most `t.rows` labelled rows come to the driver, in an order fixed by the id."""
    known = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    some = rows.filter(~held_out(F.col("doc_id"))).join(known, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    sample = some.orderBy("_h", "doc_id", "features").limit(t.rows).select("features", "quality").toArrow()
    if not sample.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0), t)
    x = np.array(sample.column("features").combine_chunks().flatten()).reshape(sample.num_rows, -1)
    return fit(x, np.array(sample.column("quality")).astype(float), t)


def score(rows: DataFrame, model: Trees) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("features").flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", "features").mapInArrow(walk, "doc_id long, score double")


def classify(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of `docs`, in their own columns, whose score is 0.5 or more."""
    names, schema = docs.columns, docs.schema

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column("text")):
                keep_row = model.score(features(text_stats(data, offsets))) >= 0.5
                part = batch.slice(row, end - row).filter(pa.array(keep_row))
                if part.num_rows:
                    yield part.select(names)

    return docs.mapInArrow(good, schema)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_features(table(spark, sf_dir, "documents"))
    scored = score(rows, train(rows, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
