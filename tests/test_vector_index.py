"""The inverted file: exact with all cells, recall with few, bounded groups, folders left unread."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_DIR

from channelgraph.operators import knn, vector_index
from channelgraph.plans.queries import registered

VECTORS = "message_id long, embedding array<float>"


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    return [(i, (centres[draw.integers(12)] + 0.5 * draw.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def asked_of(df, every):
    return df.filter(f"message_id % {every} = 0").withColumnRenamed("message_id", "query_id")


def pairs(df, most=10):
    return {(r["query_id"], r["message_id"]) for r in df.filter(f"rank <= {most}").collect()}


def test_recall_against_the_whole_search(spark, archive):
    """recall@10 on the archive's vectors with the number of cells that was measured for them."""
    for table, index in (("v1_knn_messages_whole", "v1_index_messages"), ("v2_knn_images_whole", "v2_index_images")):
        key = "message_id" if "messages" in table else "phash"
        top = [{(r["query_id"], r[key]) for r in registered()[n](spark, SF_DIR).filter("rank <= 10").collect()} for n in (table, index)]
        assert len(top[0] & top[1]) >= 0.9 * len(top[0])


def test_recall_on_more_vectors(spark, tmp_path):
    df = spark.createDataFrame(clustered(6000, 32, 1), VECTORS)
    asked = asked_of(df, 40)
    index = vector_index.build_index(df, "message_id", f"{tmp_path}/index")
    assert index.vectors.count() == 6000 and len(index.centroids) == 77
    assert 1 <= index.probes < 20  # vectors in clusters need few of their cells
    want = pairs(knn.nearest(df, asked, 10, "message_id"))
    got = pairs(vector_index.search(index, asked, 10))
    assert len(want) == 1500 and len(want & got) >= 0.9 * len(want)


def test_vectors_without_clusters_need_more_cells(spark, tmp_path):
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(2000, 48)))]
    df = spark.createDataFrame(rows, VECTORS)
    low, high = (vector_index.build_index(df, "message_id", f"{tmp_path}/{r}", recall=r) for r in (0.5, 0.95))
    assert 1 < low.probes < high.probes <= 45
    asked = asked_of(df, 20)
    want = pairs(knn.nearest(df, asked, 10, "message_id"))
    shares = [len(want & pairs(vector_index.search(x, asked, 10))) / len(want) for x in (low, high)]
    assert 0.4 < shares[0] < 0.7 and shares[1] >= 0.9


@pytest.mark.parametrize(("group", "questions"), [(8192, 1024), (7, 3)])
def test_all_cells_are_the_exact_search(spark, tmp_path, monkeypatch, group, questions):
    """Also where cells are dealt out in groups: a crowded cell and one that every question asks."""
    monkeypatch.setattr(vector_index, "GROUP", group)
    monkeypatch.setattr(vector_index, "QUESTIONS", questions)
    rows = clustered(300, 8, 2) + [(1000 + i, [1.0] * 8) for i in range(150)]  # a third are one vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, 2.0]), (2004, [1.0] * 10)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = asked_of(df, 10)
    index = vector_index.build_index(df, "message_id", f"{tmp_path}/index", cells=6)
    assert index.vectors.count() == 452
    key = lambda r: (r["query_id"], r["rank"], r["message_id"], round(r["score"], 9))
    want = sorted(map(key, knn.nearest(df, asked, 12, "message_id").collect()))
    assert sorted(map(key, vector_index.search(index, asked, 12, probes=6).collect())) == want
    few = vector_index.search(index, asked, 12, probes=2).collect()
    assert {r["query_id"] for r in few} == {w[0] for w in want}
    best = {(w[0], w[2]): w[3] for w in map(key, knn.nearest(df, asked, 500, "message_id").collect())}
    assert all(best[r["query_id"], r["message_id"]] == round(r["score"], 9) for r in few)


def test_cells_that_nobody_asks_are_not_opened(spark, tmp_path):
    df = spark.createDataFrame(clustered(800, 16, 3), VECTORS)
    index = vector_index.build_index(df, "message_id", f"{tmp_path}/index", cells=20)
    asked = asked_of(df, 800)
    wanted = {r["cell"] for r in vector_index.probed(index, asked, 2).collect()}
    found = vector_index.search(index, asked, 5, probes=2)
    before = pairs(found)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    for folder in (tmp_path / "index" / "vectors").glob("cell=*"):
        if int(folder.name[5:]) not in wanted:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")
    assert pairs(vector_index.search(index, asked, 5, probes=2)) == before


def test_empty_and_tiny_tables(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    index = vector_index.build_index(one, "message_id", f"{tmp_path}/one")
    assert vector_index.search(index, asked_of(none, 1), 3).collect() == []
    assert [r["message_id"] for r in vector_index.search(index, asked_of(one, 1), 3).collect()] == [1]
    assert vector_index.search(vector_index.build_index(none, "message_id", f"{tmp_path}/none"), asked_of(one, 1), 3).collect() == []


def test_the_sample_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame(clustered(5000, 4, 4), VECTORS)
    sample = vector_index.fitting_sample(df, "message_id", 500)
    assert 400 < sample.count() < 600
    assert {r[0] for r in sample.collect()} == {r[0] for r in vector_index.fitting_sample(df.repartition(7), "message_id", 500).collect()}
    same = [vector_index.fit_centroids(d, "message_id", 9, rows=500) for d in (df, df.repartition(5))]
    assert np.allclose(*same)
