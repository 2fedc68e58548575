"""An inverted-file index for nearest neighbours: cells around k-means centroids, a table partitioned by cell.

The centroids are fitted on a bounded sample; the table covers every valid vector. A search asks each question of the cells
nearest to it and compares all vectors of those cells exactly. How many cells that takes is measured when the index is
built: a bounded number of stored vectors is searched exactly, and as many cells are probed as hold the wanted share of what
was found. Vectors without clusters so need most of their cells, and few where they have some. Only the folders of cells that some question asks are read,
and they are read once for all questions: questions meet the vectors of a cell in groups of bounded size. With as many
probes as there are cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.operators.knn import best_positions, nearest, unit_matrix
from channelgraph.session import settle, ship_package

#: Rows the centroids are fitted on, about: those of the smallest hash of their key. All rows where there are fewer.
SAMPLE = 200_000
MOST_CELLS, ROUNDS = 4096, 4
#: Stored vectors whose neighbours tell how many cells to probe, neighbours of each, and the share of them to be found.
MEASURED, NEIGHBOURS, RECALL = 128, 10, 0.95
#: Vectors of a cell that are compared with at most so many questions at once.
GROUP, QUESTIONS = 8192, 1024


@dataclass(frozen=True)
class VectorIndex:
    """``root`` holds ``vectors`` (key, embedding, by cell) and ``centroids`` (cell, centroid); ``key`` names the id column."""

    spark: SparkSession
    root: str
    key: str
    schema: T.StructType | None = None

    @property
    def vectors(self) -> DataFrame:
        # an index without vectors has no file that tells its columns
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.root}/vectors")

    @property
    def centroids(self) -> np.ndarray:
        """Unit centroids by cell, MOST_CELLS at most."""
        return _matrix_of(self.spark.read.parquet(f"{self.root}/centroids"))


    @property
    def probes(self) -> int:
        """Cells to probe for the recall that the index was built for."""
        return self.spark.read.parquet(f"{self.root}/settings").first()["probes"]


def _matrix_of(centroids: DataFrame) -> np.ndarray:
    rows = centroids.orderBy("cell").select("centroid").toArrow().column(0)
    return unit_matrix(rows, max((len(r) for r in rows), default=1))[0]


def _seeded(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def fitting_sample(vectors: DataFrame, key: str, rows: int = SAMPLE) -> DataFrame:
    """About ``rows`` vectors, chosen by a hash of their key; all where there are no more."""
    total = vectors.count()
    if total <= rows:
        return vectors
    share = F.conv(F.substring(_seeded(key), 1, 8), 16, 10).cast("double") / float(2**32)
    return vectors.filter(share < rows / total)


def _assigned(column: pa.Array, centroids: np.ndarray, count: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest cells of each vector, nearest first, smaller cells first among equals; unit vectors; which are valid."""
    unit, valid = unit_matrix(column, max(centroids.shape[1], int(np.max(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), initial=1))))
    near = unit[:, : centroids.shape[1]] @ centroids.T
    if count == 1 and len(centroids):
        return near.argmax(axis=1)[:, None], unit, valid
    return np.argsort(-near, axis=1, kind="stable")[:, :count], unit, valid


def fit_centroids(vectors: DataFrame, key: str, cells: int | None = None, rounds: int = ROUNDS, rows: int = SAMPLE) -> np.ndarray:
    """Centroids of k-means by cosine. It begins with the vectors of the smallest hash of their key; each round assigns the sample
    in tasks and brings back the sums, as many numbers as the centroids have.

    ``cells``: the square root of the number of vectors where it is None, MOST_CELLS at most.
    """
    spark = vectors.sparkSession
    valid = vectors.filter(F.exists("embedding", lambda x: x != 0))
    if cells is None:
        cells = int(round(valid.count() ** 0.5))
    cells = max(1, min(cells, MOST_CELLS))
    sample = settle(fitting_sample(valid.select(key, "embedding"), key, rows), "index-sample")
    first = sample.orderBy(_seeded(key), key).limit(cells).select("embedding").toArrow().column(0)
    width = sample.agg(F.max(F.size("embedding"))).first()[0] or 1
    centroids = unit_matrix(first, width)[0]

    for _ in range(rounds if len(centroids) > 1 else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shared.value.shape)
            seen = np.zeros(len(total), dtype=bool)
            for batch in batches:
                cell, unit, valid = _assigned(batch.column(0), shared.value)
                np.add.at(total, cell[valid, 0], unit[valid][:, : total.shape[1]])
                seen[cell[valid, 0]] = True
            hit = np.flatnonzero(seen)
            at = np.tile(np.arange(total.shape[1]), len(hit))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(hit, total.shape[1])), pa.array(at), pa.array(total[hit].ravel())], ["cell", "at", "part"])

        parts = sample.select("embedding").mapInArrow(sums, "cell long, at long, part double")
        moved = parts.groupBy("cell", "at").agg(F.sum("part").alias("part")).toArrow()
        shared.unpersist()
        new = centroids.copy()  # a cell that nobody chose stays where it was
        cell, at = moved.column("cell").to_numpy(), moved.column("at").to_numpy()
        new[np.unique(cell)] = 0
        new[cell, at] = moved.column("part").to_numpy()
        norms = np.sqrt((new * new).sum(axis=1))
        new = np.where(norms[:, None] > 0, new / np.maximum(norms, 1e-300)[:, None], centroids)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def probes_for(index: VectorIndex, recall: float = RECALL) -> int:
    """The fewest cells that hold the share ``recall`` of the exact neighbours of MEASURED stored vectors, those of the smallest
    hash of their key. One pass over the vectors; MEASURED times NEIGHBOURS cells come back."""
    key, vectors = index.key, index.vectors
    measured = settle(vectors.select(F.col(key).alias("query_id"), "embedding").orderBy(_seeded(key), key).limit(MEASURED), "index-measured")
    near = nearest(vectors, measured, NEIGHBOURS + 1, key).filter(F.col("query_id") != F.col(key))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("nth") <= NEIGHBOURS)
    cells = near.select("query_id", key).join(vectors.select(key, "cell"), key).select("query_id", "cell").toArrow()
    asked = measured.toArrow()
    order, _, _ = _assigned(asked.column("embedding").combine_chunks(), index.centroids, MOST_CELLS)
    place = {q: {c: n for n, c in enumerate(row.tolist(), 1)} for q, row in zip(asked.column("query_id").to_pylist(), order, strict=True)}
    needed = sorted(place[q][c] for q, c in zip(cells.column("query_id").to_pylist(), cells.column("cell").to_pylist(), strict=True))
    return needed[int(np.ceil(recall * len(needed))) - 1] if needed else 1


def build_index(
    vectors: DataFrame, key: str, root: str, cells: int | None = None, rounds: int = ROUNDS, rows: int = SAMPLE, recall: float = RECALL
) -> VectorIndex:
    """Write the index of all valid vectors. Null, empty and zero vectors take no part."""
    spark = vectors.sparkSession
    ship_package(spark)
    centroids = fit_centroids(vectors, key, cells, rounds, rows)
    listed = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(listed, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{root}/centroids")
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _, valid = _assigned(batch.column(1), shared.value)
            keep = pa.array(valid)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(cell[valid, 0].astype(np.int32))], [key, "embedding", "cell"])

    slim = vectors.select(key, "embedding").filter(F.exists("embedding", lambda x: x != 0))
    placed = slim.mapInArrow(assign, T.StructType([*slim.schema.fields, T.StructField("cell", T.IntegerType())]))
    # a crowded cell lies in several files
    placed.repartitionByRange("cell", F.xxhash64(key)).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{root}/vectors")
    index = VectorIndex(spark, root, key, placed.schema)
    spark.createDataFrame([(probes_for(index, recall), recall)], "probes int, recall double").coalesce(1).write.parquet(f"{root}/settings")
    return index


def probed(index: VectorIndex, queries: DataFrame, probes: int, query_key: str = "query_id") -> DataFrame:
    """query_key, cell and embedding of each question, once for each of the ``probes`` cells nearest to it."""
    shared = index.spark.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, _, valid = _assigned(batch.column(1), shared.value, probes)
            row = np.repeat(np.flatnonzero(valid), cells.shape[1])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells[valid].ravel().astype(np.int32))], [query_key, "embedding", "cell"])

    slim = queries.select(query_key, "embedding").filter(F.exists("embedding", lambda x: x != 0))
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("cell", T.IntegerType())]))


def _compared(k: int, key_type: pa.DataType, query_type: pa.DataType):
    """The k nearest of a group of vectors for each question of the group; both sides are of bounded size."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        queries, vectors = asked.column("asked"), held.column("held")
        width = max(int(np.max([len(v) for v in queries], initial=1)), int(np.max([len(v) for v in vectors], initial=1)))
        scores = unit_matrix(vectors, width)[0] @ unit_matrix(queries, width)[0].T
        ids = held.column("key").to_numpy(zero_copy_only=False)
        rows, places, names = [], [], asked.column("query").to_numpy(zero_copy_only=False)
        for q in range(scores.shape[1]):
            best = best_positions(scores[:, q], ids, k)
            rows.append(np.full(len(best), q))
            places.append(best)
        row, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
        return pa.table({"query": pa.array(names[row].tolist(), query_type), "key": pa.array(ids[place].tolist(), key_type), "score": pa.array(scores[place, row], pa.float64())})

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, query_key: str = "query_id") -> DataFrame:
    """query_key, key, score and rank of the ``k`` nearest vectors by cosine in the ``probes`` cells nearest to each question
    (as many as were measured for the index where it is None).

    A question has fewer than ``k`` rows only where its cells hold fewer vectors. Equal scores rank by the key.
    """
    ship_package(index.spark)
    asked = settle(probed(index, queries, probes or index.probes, query_key), "index-probes")
    load = asked.groupBy("cell").agg(F.count("*").alias("n_asked"))  # one row a cell
    load = settle(load.withColumn("parts", F.ceil(F.col("n_asked") / QUESTIONS).cast("int")), "index-load")
    vectors = index.vectors
    # the cells that were asked are known when the scan starts, so it opens no folder of another cell
    touched = vectors.join(F.broadcast(load.filter("n_asked > 0")), "cell")
    sizes = settle(touched.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("slots"), F.first("parts").alias("parts")), "index-sizes")
    size = F.broadcast(sizes.filter("slots > 0"))
    group = ["cell", "slot", "part"]
    held = vectors.join(size, "cell").select(
        "cell", F.pmod(F.xxhash64(index.key), F.col("slots")).cast("int").alias("slot"), F.col(index.key).alias("key"), F.col("embedding").alias("held"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    questions = asked.join(size, "cell").select(
        "cell", F.pmod(F.xxhash64(query_key), F.col("parts")).cast("int").alias("part"), F.col(query_key).alias("query"), F.col("embedding").alias("asked"),
        F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"),
    )
    kinds = held.schema["key"].dataType, questions.schema["query"].dataType
    arrow = [pa.int64() if isinstance(t, T.LongType) else pa.string() for t in kinds]
    out = T.StructType([T.StructField("query", kinds[1]), T.StructField("key", kinds[0]), T.StructField("score", T.DoubleType())])
    found = questions.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(_compared(k, *arrow), out)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_key), F.col("key").alias(index.key), "score", "rank")
