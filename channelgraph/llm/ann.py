"""Nearest neighbours by randomly rotated one-bit codes.

A vector is kept as the signs of its rotated offset from the centre of all vectors, 64 to a word, with two numbers: the
offset's length and the inner product of the offset's direction with its own code. A query's direction is rounded to a few
bits and kept as bit planes, so its inner product with a code is a weighted sum of bit counts of ANDed words. From it follows
an estimate of the distance, with a bound on the error. A search reads codes only, twice: the first pass finds the k rows
of each query that seem nearest, whose true distances bound what its k nearest can be; the second marks every row whose
smallest possible distance is within that bound. Only the vectors of marked rows are joined and compared in full. Queries go
over the codes in blocks of bounded size, marks are one bit per query of the block, and each task returns its k best
per query, so neither the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channelgraph.llm.common import documents, drop_settled, settle, ship_package

QUERY_BLOCK = 1024
#: Width of the probabilistic error bound in standard deviations; the certain bound is used where it is tighter.
SIGMAS = 6.0
#: Bits of a component of a query's direction.
PLANES = 6
ROWS, PAIRS = 512, 1 << 15
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; every task makes the same one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: id not null; vector not null, not zero, all
    components present and finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64, copy=False) if len(column) else np.zeros((0, 0))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the last one filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(offsets: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of each direction with its code."""
    length = np.sqrt((offsets * offsets).sum(axis=1))
    turned = offsets @ turn
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.abs(turned).sum(axis=1) / (length * np.sqrt(offsets.shape[1]))
    return _words(turned >= 0), length, np.where(length > 0, np.minimum(fit, 1.0), 1.0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, np.ndarray]:
    """The index of all usable rows (row, vec_id, vector, code, length, fit), their dimension and centre.

    Vectors of another length than most (the longer one where two are as common) take no part: distances to them are not
    defined. Vectors keep the precision they came in, so single ones take half the room; ``row`` tells rows with one id apart.
    """
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 1
    rows = rows.filter(F.size("vector") == dim)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                total += _matrix(batch.column(0)).sum(axis=0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())], ["at", "part", "n"])

    parts = rows.select("vector").mapInArrow(sums, "at int, part double, n long").filter("n > 0")
    means = parts.groupBy("at").agg((F.sum("part") / F.sum("n")).alias("mean")).collect()  # one row per dimension
    centre = np.zeros(dim)
    for r in means:
        centre[r["at"]] = r["mean"] or 0.0

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            code, length, fit = encode(_matrix(batch.column(2)) - centre, turn)
            packed = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(length), pa.array(fit)], ["row", "vec_id", "vector", "code", "length", "fit"])

    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("vector").cast(kind).alias("vector"))
    index = keyed.mapInArrow(codes, f"row long, vec_id long, vector {kind}, code binary, length double, fit double")
    return settle(index, "ann-index"), dim, centre


def distances(left: np.ndarray, right: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Euclidean distances of left[:, row] and right[:, column], components added in order."""
    total = np.zeros(len(row))
    for one, other in zip(left, right, strict=True):
        step = one[row] - other[column]
        step *= step
        total += step
    return np.sqrt(total)


class QueryPlanes:
    """A block of queries: their rotated directions as bit planes, to be held against codes."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray):
        self.ids, self.dim = ids, queries.shape[1]
        offsets = queries - centre
        self.length = np.sqrt((offsets * offsets).sum(axis=1))
        direction = (offsets / np.where(self.length > 0, self.length, 1)[:, None]) @ rotation(self.dim)
        self.low = direction.min(axis=1)
        self.step = (direction.max(axis=1) - self.low) / (2**PLANES - 1)
        level = np.rint((direction - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        self.planes = [_words((level >> p) & 1 == 1) for p in range(PLANES)]
        rounded = self.low[:, None] + self.step[:, None] * level
        self.sum = rounded.sum(axis=1)
        #: how far rounding can move an inner product with a code
        self.off = np.abs(direction - rounded).sum(axis=1) / np.sqrt(self.dim) + 1e-12

    def with_code(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of rounded directions and codes (rows by queries), by counting bits."""
        total = np.zeros((len(codes), len(self.ids)), dtype=np.int32)
        for p, plane in enumerate(self.planes):
            for word in range(codes.shape[1]):
                total += np.bitwise_count(codes[:, word, None] & plane[None, :, word]).astype(np.int32) << p
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        return (2 * (self.low[None] * ones[:, None] + self.step[None] * total) - self.sum[None]) / np.sqrt(self.dim)

    def squares(self, codes: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated and smallest possible squared distances, rows by queries."""
        seen, fit = self.with_code(codes), fit[:, None]
        rest = np.sqrt(1 - fit**2)
        inner = seen / fit
        likely = inner + self.off[None] / fit + rest / fit * (SIGMAS / np.sqrt(max(1, self.dim - 1)))
        # certain: the code gives the part along it, the rest of both directions may agree wholly
        along = np.clip(np.clip(fit, seen - self.off[None], seen + self.off[None]), -1, 1)
        certain = fit * along + rest * np.sqrt(1 - along**2)
        middle = length[:, None] ** 2 + self.length[None] ** 2
        scale = 2 * length[:, None] * self.length[None]
        return middle - scale * inner, middle - scale * np.minimum(likely, certain + 1e-12)


class Seeds:
    """For each query of a block the k rows that seem nearest by their codes."""

    def __init__(self, block: QueryPlanes, k: int):
        self.block, self.k = block, k
        self.best = np.full((k, len(block.ids)), np.inf)
        self.row = np.full((k, len(block.ids)), -1, dtype=np.int64)

    def add(self, row: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray) -> None:
        estimate = self.block.squares(codes, length, fit)[0]
        estimate[ids[:, None] == self.block.ids[None]] = np.inf
        if len(ids) > self.k:
            near = np.argpartition(estimate, self.k - 1, axis=0)[: self.k]
        else:
            near = np.broadcast_to(np.arange(len(ids))[:, None], estimate.shape)
        both = np.concatenate([self.best, np.take_along_axis(estimate, near, axis=0)])
        rows = np.concatenate([self.row, row[near]])
        first = np.argsort(both, axis=0, kind="stable")[: self.k]
        self.best, self.row = np.take_along_axis(both, first, axis=0), np.take_along_axis(rows, first, axis=0)


def marks(block: QueryPlanes, within: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Whether each row (by query) may be nearer than the query's bound."""
    least = block.squares(codes, length, fit)[1]
    return (ids[:, None] != block.ids[None]) & (least <= within[None] ** 2 * (1 + 1e-9) + 1e-9 * (1 + block.length[None] ** 2))


class Rerank:
    """The k nearest of the marked rows seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, np.ascontiguousarray(queries.T), k
        self.best = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), -1, dtype=np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, marked: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors.T)
        row, query = np.nonzero(marked)
        for a in range(0, len(row), PAIRS):
            self._compare(ids, columns, row[a : a + PAIRS], query[a : a + PAIRS])

    def _compare(self, ids: np.ndarray, columns: np.ndarray, row: np.ndarray, query: np.ndarray) -> None:
        score = distances(columns, self.queries, row, query)
        near = score <= self.best[query, -1]
        row, query, score = row[near], query[near], score[near]
        touched = np.unique(query)
        old_q = np.repeat(touched, self.k)
        all_q = np.concatenate([old_q, query])
        all_s = np.concatenate([self.best[touched].ravel(), score])
        all_i = np.concatenate([self.found[touched].ravel(), ids[row]])
        order = np.lexsort((all_i, all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        kept = place < self.k
        self.best[all_q[kept], place[kept]] = all_s[kept]
        self.found[all_q[kept], place[kept]] = all_i[kept]


CODES = ["row", "vec_id", "code", "length", "fit"]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _code_parts(batches: Iterator[pa.RecordBatch]):
    for part in _slices(batches):
        row, ids, code, length, fit = part.columns
        yield _numbers(row), _numbers(ids), _bytes(code, np.uint64), _numbers(length), _numbers(fit)


def _seed(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, centre = block.value
        seeds = Seeds(QueryPlanes(ids, queries, centre), k)
        for part in _code_parts(batches):
            seeds.add(*part)
        place, query = np.nonzero(np.isfinite(seeds.best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(seeds.row[place, query]), pa.array(seeds.best[place, query])], ["query_id", "row", "estimate"]
        )

    return run


def _mark(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, centre, within = block.value
        planes = QueryPlanes(ids, queries, centre)
        for row, *part in _code_parts(batches):
            marked = marks(planes, within, *part)
            some = marked.any(axis=1)
            packed = np.packbits(marked[some], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array([m.tobytes() for m in packed], pa.binary())], ["row", "marked"])

    return run


def _rerank(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = block.value[:2]
        search = Rerank(ids, queries, k)
        for part in _slices(batches):
            marked = np.unpackbits(_bytes(part.column(2), np.uint8), axis=1, count=len(ids)).astype(bool)
            search.add(_numbers(part.column(0)), _matrix(part.column(1)), marked)
        query, place = np.nonzero(np.isfinite(search.best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(search.ids[query]), pa.array(search.found[query, place]), pa.array(search.best[query, place])], ["query_id", "vec_id", "score"]
        )

    return run


def _first(rows: DataFrame, k: int, *order: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", best).filter(F.col("rank") <= k)


def _bounds(seeds: DataFrame, index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """vec_id of each query and ``within``: the largest true distance of its k seeds, infinite where it has fewer."""
    ends = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").cast("array<double>").alias("asked"))
    pairs = seeds.join(index.select("row", F.col("vector").cast("array<double>").alias("vector")), "row").join(ends, "query_id")
    squares = F.zip_with("vector", "asked", lambda a, b: (a - b) * (a - b))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    held = pairs.groupBy("query_id").agg(F.max(score).alias("far"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    return held.select(F.col("query_id").alias("vec_id"), bound.alias("within"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows of each row whose id is divisible by ``every``.

    Nearest first, equal distances by the smaller id. A query id that stands in several rows is asked once, with the
    smallest of its vectors; as candidates all rows count. An empty table, or one without usable rows, gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    index, _, centre = build_index(vectors, id_col, vector_col)
    codes = index.select(*CODES)
    asked = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = settle(asked, "ann-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))

    def arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["vec_id"] for r in rows]), np.array([r["vector"] for r in rows], dtype=np.float64)

    seeds, partial = None, None
    for number in range(blocks):
        rows = asked.filter(block_of == number).collect()  # one block
        if not rows:
            continue
        block = spark.sparkContext.broadcast((*arrays(rows), centre))
        likely = codes.mapInArrow(_seed(block, k), "query_id long, row long, estimate double")
        top = settle(_first(likely, k, "estimate", "row").select("query_id", "row"), "ann-seeds")
        block.unpersist()
        seeds = top if seeds is None else seeds.unionByName(top)
    if seeds is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bounded = settle(asked.join(_bounds(seeds, index, asked, k), "vec_id", "left"), "ann-bounds")
    drop_settled(seeds)
    for number in range(blocks):
        rows = bounded.filter(block_of == number).collect()  # one block
        if not rows:
            continue
        within = np.array([float("inf") if r["within"] is None else r["within"] for r in rows])
        block = spark.sparkContext.broadcast((*arrays(rows), centre, within))
        marked = codes.mapInArrow(_mark(block), "row long, marked binary")
        kept = index.select("row", "vec_id", "vector").join(marked, "row").select("vec_id", "vector", "marked")
        found = settle(kept.mapInArrow(_rerank(block, k), "query_id long, vec_id long, score double"), "ann-found")
        block.unpersist()
        top = _first(found, k, "score", "vec_id")
        top = settle(top, "ann-top") if blocks > 1 else top
        partial = top if partial is None else partial.unionByName(top)
    return partial.select("query_id", "rank", "vec_id", "score")


def op5_rotated_codes(spark, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"))


ORACLE_OP5 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
