import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from channelgraph.llm import quality, registry

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in registry.queries()["op6_boosted_trees"](spark, SF).collect()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    assert len(rows) == pq.read_table(f"{SF}/documents.parquet").num_rows
    unseen = [r for r in labels if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(unseen) > 50 and all(rows[r["doc_id"]]["held_out"] for r in unseen)
    assert sum(rows[r["doc_id"]]["predicted"] == r["quality"] for r in unseen) >= 0.97 * len(unseen)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows.values())


def test_boosting_learns_what_no_line_parts():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.grow(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95


def test_flat_trees_equal_a_walk():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 4))
    forest = quality.grow(x, (x[:, 1] + x[:, 2] > 0).astype(float), trees=9, depth=3)
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = forest.prior
        for t in range(9):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.cut[t, node])
            total += forest.leaf[t, node - 7]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12


def plain_forest(x, y, trees, depth, bins):
    """Boosting written out: for every node every cut is tried on the rows themselves. Returns the score of each row."""
    rate = min(max(sum(y) / len(y), 0.01), 0.99)
    margin = [math.log(rate / (1 - rate))] * len(y)
    cuts = [sorted(set(np.quantile([r[f] for r in x], [b / bins for b in range(1, bins)]).tolist())) for f in range(len(x[0]))]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, split = 1e-9, (rows, [])
                total = sum(y[i] - p[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)
                for f, options in enumerate(cuts):
                    for cut in options:
                        left = [i for i in rows if x[i][f] <= cut]
                        g, h = sum(y[i] - p[i] for i in left), sum(p[i] * (1 - p[i]) for i in left)
                        if h < quality.LEAST_WEIGHT or total[1] - h < quality.LEAST_WEIGHT:
                            continue
                        gain = g * g / (h + quality.RIDGE) + (total[0] - g) ** 2 / (total[1] - h + quality.RIDGE) - total[0] ** 2 / (total[1] + quality.RIDGE)
                        if gain > best + 1e-12:
                            best, split = gain, (left, [i for i in rows if x[i][f] > cut])
                below += split
            nodes = below
        for rows in nodes:
            g, h = sum(y[i] - p[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)
            for i in rows:
                margin[i] += quality.RATE * g / (h + quality.RIDGE)
    return [1 / (1 + math.exp(-m)) for m in margin]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_histograms_grow_what_a_plain_grower_does(seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(160, 4)), 1)  # many ties
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0) ^ (draw.random(160) < 0.1)).astype(float)
    forest = quality.grow(x, y, trees=6, depth=3, bins=12)
    assert np.allclose(forest.score(x), plain_forest(x.tolist(), y.tolist(), 6, 3, 12), rtol=0, atol=1e-9)


def junk(draw):
    return " ".join(draw.choice(["BUY!!", "NOW!!", "x$$$"]) for _ in range(40))


def prose(draw):
    return " ".join("".join(draw.choice("aeiorst") for _ in range(draw.randrange(2, 8))) for _ in range(60)) + "."


def test_edge_rows(spark, docs_of, clashing):
    draw = random.Random(4)
    rows = [(i, prose(draw) if i % 3 else junk(draw)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "word " * 60_000), (None, prose(draw)), (5, junk(draw)), (5, junk(draw))]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(7, None, 0), (8, 9, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    df = clashing(docs_of(rows))
    got = quality.scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert not next(r for r in got if r["id"] is None)["held_out"]
    unseen = [r for r in got if r["held_out"] and r["id"] < 400]
    assert sum(r["predicted"] == int(r["id"] % 3 > 0) for r in unseen) >= 0.97 * len(unseen)
    out = quality.accepted(df, labels)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["id"]) for r in got if r["predicted"])


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scores(docs_of([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert quality.scores(docs_of([]), none).collect() == [] and quality.accepted(docs_of([]), none).collect() == []
    one = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    assert {r["score"] > 0.9 for r in quality.scores(docs_of([(i, "a") for i in range(8)]), one).collect()} == {True}


def test_sample_is_bounded(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(3000)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    grow = quality.grow
    try:
        quality.grow = lambda x, y: seen.append(len(y)) or grow(x, y)
        quality.train(quality.with_features(docs, "doc_id", "text"), labels, rows=200)
    finally:
        quality.grow = grow
    assert seen == [200]
