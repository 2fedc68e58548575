"""Exact nearest neighbours and best matches of vectors, in NumPy over Arrow batches inside Spark tasks.

The vectors to search stay partitioned where Spark has them. The questions asked of them are broadcast in blocks of a
fixed size, one pass per block. Where there is more than one block, each pass writes its small result and gives its
broadcast back before the next begins, so that one block at most is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.functions.predicates import local_path
from channelgraph.functions.text import is_dedupable, stored_has_text
from channelgraph.operators.texts import with_texts
from channelgraph.session import drop_settled, settle

# 1024 vectors of 1280 doubles are 10 MiB.
BLOCK = 1024


def unit_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors, padded with zeros, and which of them are valid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.nan_to_num(values, nan=0.0)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), width))
    out[rows, cols] = values
    norms = np.sqrt((out * out).sum(axis=1))
    valid = norms > 0
    out[valid] /= norms[valid, None]
    return out, valid


def query_blocks(queries: DataFrame, key: str, size: int = BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """Valid query vectors in blocks of at most ``size``, streamed to the driver one partition at a time."""
    ids: list = []
    rows: list = []

    def block():
        width = max(len(r) for r in rows)
        return ids, unit_matrix(pa.array(rows, pa.list_(pa.float64())), width)[0]

    for row in queries.select(key, "embedding").toLocalIterator():
        vector = row["embedding"]
        if vector and any(vector):
            ids.append(row[key])
            rows.append(vector)
        if len(ids) == size:
            yield block()
            ids, rows = [], []
    if ids:
        yield block()


def _scored(column: pa.Array, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of a batch against all questions. A vector wider than the questions loses only zeros of theirs."""
    width = max(matrix.shape[1], int(np.max(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), initial=1)))
    unit, valid = unit_matrix(column, width)
    return unit[:, : matrix.shape[1]] @ matrix[:, :width].T, valid


def best_positions(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, smaller ids first among equals."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, query_key: str = "query_id") -> DataFrame:
    """The ``k`` nearest vectors of every query by cosine, with rank.

    Each task keeps only the k best per query it has seen, and the tasks' lists are merged by one window whose groups
    hold k rows per task.
    """
    spark = vectors.sparkSession
    kinds = {key: vectors.schema[key].dataType, query_key: queries.schema[query_key].dataType}
    out = T.StructType(
        [T.StructField(query_key, kinds[query_key]), T.StructField(key, kinds[key]), T.StructField("score", T.DoubleType())]
    )
    slim = vectors.select(key, "embedding")
    id_type = pa.int64() if isinstance(kinds[key], T.LongType) else pa.string()
    query_type = pa.int64() if isinstance(kinds[query_key], T.LongType) else pa.string()

    best_first = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))

    def pass_over(shared) -> DataFrame:
        def search(batches):
            asked, matrix = shared.value
            best: list = [(np.empty(0), None)] * len(asked)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                scores, valid = _scored(batch.column(1), matrix)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[valid]
                scores = scores[valid]
                for q in range(len(asked)):
                    held, names = best[q]
                    merged = np.concatenate([held, scores[:, q]])
                    both = ids if names is None else np.concatenate([names, ids])
                    at = best_positions(merged, both, k)
                    best[q] = (merged[at], both[at])
            for q, (held, names) in enumerate(best):
                if names is not None and len(held):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([asked[q]] * len(held), query_type),
                            pa.array(names.tolist(), id_type),
                            pa.array(held, pa.float64()),
                        ],
                        names=[query_key, key, "score"],
                    )

        found = slim.mapInArrow(search, out)
        return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)

    # a question is in one block only, so the passes need no merging
    passes = list(_passes(spark, query_blocks(queries, query_key), pass_over, "nearest"))
    if not passes:
        return spark.createDataFrame([], out.add("rank", T.IntegerType()))
    return reduce(DataFrame.unionByName, passes)


def _passes(spark, blocks: Iterator, pass_over, name: str) -> Iterator[DataFrame]:
    """The result of each block. A lone block stays a plan; of several, each is written before the next is sent."""
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        result = pass_over(shared)
        if after is not None or name.endswith("-more"):
            result = settle(result, name)
            shared.unpersist()
            name = name.removesuffix("-more") + "-more"
        yield result
        block = after


def best_match(vectors: DataFrame, inputs: DataFrame, key: str, input_key: str = "id") -> DataFrame | None:
    """For every valid vector the highest cosine with any input, as ``s``. ``None`` when there is no valid input."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("s", T.DoubleType())])
    slim = vectors.select(key, "embedding")

    def pass_over(shared) -> DataFrame:
        def score(batches):
            matrix = shared.value[1]
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                scores, valid = _scored(batch.column(1), matrix)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(valid)), pa.array(scores[valid].max(axis=1), pa.float64())],
                    names=[key, "s"],
                )

        return slim.mapInArrow(score, out)

    best = None
    for found in _passes(spark, query_blocks(inputs, input_key), pass_over, "best-match"):
        if best is None:
            best = found
            continue
        # one row per vector is carried from pass to pass, however many there are
        folded = settle(best.unionByName(found).groupBy(key).agg(F.max("s").alias("s")), "best-match")
        drop_settled(best)
        drop_settled(found)
        best = folded
    return best


def best_inputs(vectors: DataFrame, inputs: DataFrame, key: str, n: int, input_key: str = "id") -> DataFrame | None:
    """For every valid vector its ``n`` inputs of highest cosine, as ``best`` (array of s and input, best first).

    ``None`` when there is no valid input. Inputs come in blocks, and one list per vector is carried from block to block.
    """
    kind = vectors.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("best", INPUT_LIST)])
    slim = vectors.select(key, "embedding")

    def pass_over(shared) -> DataFrame:
        def score(batches):
            asked, matrix = shared.value
            ids = np.array(asked, dtype=np.int64)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                scores, valid = _scored(batch.column(1), matrix)
                scores = scores[valid]
                first = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)[:, :n]
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.take_along_axis(scores, first, axis=1).ravel(), pa.float64()), pa.array(ids[first].ravel(), pa.int64())], ["s", "input"]
                )
                ends = pa.array(np.arange(len(first) + 1) * first.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(valid)), lists], names=[key, "best"])

        return slim.mapInArrow(score, out)

    best = None
    for found in _passes(vectors.sparkSession, query_blocks(inputs, input_key), pass_over, "best-inputs"):
        if best is None:
            best = found
            continue
        both = best.join(found.withColumnRenamed("best", "more"), key)
        folded = settle(both.select(key, F.slice(best_first(F.concat("best", "more")), 1, n).alias("best")), "best-inputs")
        drop_settled(best)
        drop_settled(found)
        best = folded
    return best


INPUT_LIST = T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("input", T.LongType())]))


def best_first(pairs):
    """A list of s and input in order of falling s, smaller ids first among equals."""
    turned = F.transform(pairs, lambda p: F.struct((-p["s"]).alias("t"), p["input"].alias("input")))
    return F.transform(F.array_sort(turned), lambda p: F.struct((-p["t"]).alias("s"), p["input"].alias("input")))


# ---- search over the archive

def knn_messages(
    vectors: DataFrame, queries: DataFrame, k: int, model: str, messages: DataFrame | None = None, peer: int | None = None
) -> DataFrame:
    """Nearest messages by text vector, optionally only those of one peer."""
    pool = vectors.filter(F.col("model_id") == model)
    if peer is not None:
        posted = messages.filter(F.col("peer_external_id") == peer).select(F.col("id").alias("message_id"))
        pool = pool.join(posted, "message_id", "left_semi")
    return nearest(pool, queries, k, "message_id")


def knn_images(
    vectors: DataFrame, queries: DataFrame, k: int, model: str, links: DataFrame | None = None, peer: int | None = None
) -> DataFrame:
    """Nearest images, optionally only those that appear in one peer."""
    pool = vectors.filter(F.col("model_id") == model)
    if peer is not None:
        shown = links.filter(F.col("peer_external_id") == peer).select("phash")
        pool = pool.join(shown, "phash", "left_semi")
    return nearest(pool, queries, k, "phash")


def hydrate(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Search hits with the rows they stand for, in rank order within a query; hits without a row drop out."""
    return rows.join(hits.select("query_id", key, "rank", F.bround("score", 4).alias("score")), key)


# ---- what is still to be embedded

def _pending(rows: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    done = vectors.select(key, F.col("model_id").alias("done_by"))
    return rows.join(done, key, "left").filter(~F.col("done_by").eqNullSafe(F.lit(model))).drop("done_by")


def pending_text(
    messages: DataFrame, vectors: DataFrame, model: str, peer: int | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Messages with text that this model has not embedded. ``texts`` (text_id, content) resolves references of those."""
    rows = messages.filter(stored_has_text(messages.columns))
    if peer is not None:
        rows = rows.filter(F.col("peer_external_id") == peer)
    carried = ["content"] if texts is None else ["content", "text_ref"]
    rows = _pending(rows.select(F.col("id").alias("message_id"), *carried, "date"), vectors, "message_id", model)
    return rows if texts is None else with_texts(rows, texts)


def pending_images(
    blobs: DataFrame,
    vectors: DataFrame,
    cache: DataFrame,
    model: str,
    links: DataFrame | None = None,
    peer: int | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Images whose bytes are at hand and that this model has not embedded."""
    cached = cache.select("phash", F.lit(True).alias("cached")).dropDuplicates(["phash"])
    rows = blobs.filter(is_dedupable(F.col("phash"))).join(cached, "phash", "left")
    rows = rows.filter(local_path(F.col("canonical_path")) | F.col("cached").isNotNull()).drop("cached")
    if peer is not None:
        rows = rows.join(links.filter(F.col("peer_external_id") == peer).select("phash"), "phash", "left_semi")
    if exclude is not None:
        rows = rows.join(exclude.select("phash"), "phash", "left_anti")
    return _pending(rows, vectors, "phash", model)
