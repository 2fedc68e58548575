"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are grown with numpy on a bounded sample of labelled rows and flattened into arrays; a batch of documents walks
all trees at once, a level at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.llm.common import documents, settle, utf8

#: Labelled rows the trees are grown on, at most: those of the smallest hash of their id.
TRAINING_ROWS = 40_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 80, 4, 64, 0.15, 4.0, 1.0

FEATURES = (
    "bytes", "words", "lines", "bytes_per_word", "words_per_line", "upper", "digits", "spaces", "other_bytes", "high_bytes", "stops",
    "commas", "bangs", "bars", "symbols", "quotes", "distinct_words", "top_word", "distinct_lines", "top_line", "entropy", "longest_word",
    "long_words", "marked_ends", "repeated_bytes",
)


def _groups() -> np.ndarray:
    """A group for each byte value: what kind of character it is."""
    kind = np.zeros(256, dtype=np.int64)
    for group, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n\x0b\x0c", ".", ",;:", "!?", "|", "#$%&*+=@^~_\\/<>", "\"'`()[]{}-"), 1):
        kind[list(chars.encode())] = group
    kind[128:] = 10
    return kind


GROUPS = _groups()


def statistics(text: bytes) -> list[float]:
    """The features of one whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    share = np.bincount(GROUPS, weights=counts, minlength=11) / n
    words, lines = text.split(), text.split(b"\n")
    w, l = max(1, len(words)), len(lines)
    seen, kinds = Counter(words), Counter(lines)
    p = counts[counts > 0] / n
    lengths = np.array([len(x) for x in words]) if words else np.zeros(1)
    return [
        n, w, l, n / w, w / l, share[1], share[2], share[3], share[0], share[10], share[4], share[5], share[6], share[7], share[8], share[9],
        len(seen) / w, max(seen.values(), default=0) / w, len(kinds) / l, max(kinds.values()) / l, float(-(p * np.log2(p)).sum()),
        float(lengths.max()), float((lengths > 20).mean()), sum(x[-1:] in b"!$%&#*|" for x in words) / w, float((data[1:] == data[:-1]).mean()) if n > 1 else 0.0,
    ]


def feature_matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in utf8(texts)]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


@dataclass
class Forest:
    """All trees as arrays over nodes: a tree's node i has the children 2i + 1 and 2i + 2, leaves lead to themselves."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.prior)
        if not trees or not len(x):
            return 1 / (1 + np.exp(-total))
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        total += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosts trees of equal depth on the logistic loss; splits are chosen on histograms of quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    rate = y.mean() if len(y) else 0.5
    prior = float(np.log(np.clip(rate, 0.01, 0.99) / (1 - np.clip(rate, 0.01, 0.99))))
    if not len(y) or rate in (0.0, 1.0):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), prior)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    cuts = np.full((m, bins), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    flat = binned + np.arange(m)[None] * bins
    margin = np.full(len(y), prior)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * (m * bins) + flat).ravel()
            size = width * m * bins
            g = np.bincount(at, np.repeat(grad, m), size).reshape(width, m, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, m), size).reshape(width, m, bins).cumsum(axis=2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT) | ~np.isfinite(cuts)[None]] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature, place = best // bins, best % bins
            first = width - 1
            out.feature[t, first : first + width] = np.where(useful, feature, 0)
            out.cut[t, first : first + width] = np.where(useful, cuts[feature, place], np.inf)
            right = useful[node] & (binned[np.arange(len(y)), feature[node]] > place[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        out.leaf[t] = RATE * g / (h + RIDGE)
        margin += out.leaf[t][node]
    return out


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], ["id", *FEATURES])

    return narrow.mapInArrow(run, T.StructType([T.StructField("id", narrow.schema[id_col].dataType), *[T.StructField(f, T.DoubleType()) for f in FEATURES]]))


def train(features: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, label_col: str = "quality") -> Forest:
    """Grows the trees on at most ``rows`` labelled rows that are not held out.

    ``features``: id and the features; ``labels``: doc_id and a label of 0 or 1 (others are not read; of several for
    one id the smallest counts). Without both labels the score is the share of label 1 (one half without any).
    """
    wanted = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).alias("_label"))
    wanted = settle(wanted, "quality-labels")
    order = F.xxhash64("_id")
    # thinned by the same hash before one task picks the smallest, so that it never sees many more than it keeps
    share = min(1.0, 1.25 * rows / max(1, wanted.count()))
    wanted = wanted.filter(order.cast("double") <= (2 * share - 1) * 2.0**63)
    joined = features.join(wanted, F.col("id") == F.col("_id"))
    sample = joined.select("_label", *FEATURES, order.alias("_order")).orderBy("_order").limit(rows).drop("_order").toArrow()
    x = np.stack([sample.column(f).to_numpy() for f in FEATURES], axis=1) if sample.num_rows else np.zeros((0, len(FEATURES)))
    y = sample.column("_label").to_numpy().astype(float) if sample.num_rows else np.zeros(0)
    keep = np.argsort(y, kind="stable")  # equal hashes may come in any order; sums must not depend on it
    return grow(x[keep], y[keep])


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1) and predicted (score >= threshold).

    Null text counts as empty and gets the score that the trees give an empty text. Repeated rows get equal scores.
    """
    features = settle(with_features(docs, id_col, text_col), "quality-features")
    forest = train(features, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], ["id", "score"])

    scored = features.mapInArrow(run, T.StructType([features.schema["id"], T.StructField("score", T.DoubleType())]))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were. Texts are read where they are, not moved.

    They are read twice, for the trees and for the scores.
    """
    forest = train(with_features(docs, id_col, text_col), labels)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(pc.struct_field(batch.column(0), text_col))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(forest.score(x) >= threshold))], ["row"])

    return held.mapInArrow(run, held.schema).select("row.*")


def op6_boosted_trees(spark, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
