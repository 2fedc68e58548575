"""Whitening of embeddings on their leading components.

Entries become integers, so that sums are exact. Each different vector counts once: Spark makes them distinct, sums them,
and adds up their centred products task by task; what reaches the driver is one matrix of dimensions by dimensions. Its leading
eigenpairs come from contour integration (:mod:`channelgraph.llm.feast`). All rows are then projected where they are, and the
covariance of what was whitened is measured over the different vectors once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import documents, settle, ship_package
from channelgraph.llm.feast import leading

COMPONENTS = 16
# fixed values: an entry c becomes floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this have no exact place among the integers of a double.
LARGEST = float(2**45)
ROWS = 4096
OUT = (
    "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x (array<bigint>) of the rows whose vector has finite entries only."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    rows = rows.filter(F.col("c").isNotNull()).filter(F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            total += _matrix(batch.column(0), dim).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())], ["at", "part", "n"])

    return run


def _products(dim: int, width: int, prepare):
    """Sums of the products of every two columns of what ``prepare`` makes of the vectors: cell i * width + j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = prepare(_matrix(batch.column(0), dim))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "part"])

    return run


def _covariance(fit: DataFrame, n: int, dim: int, width: int, prepare) -> np.ndarray:
    """The sums of all tasks over n: width * width numbers, however many vectors there are."""
    parts = fit.mapInArrow(_products(dim, width, prepare), "cell long, part double")
    out = np.zeros(width * width)
    for row in parts.groupBy("cell").agg(F.sum("part").alias("part")).collect():
        out[row["cell"]] = row["part"]
    out = out.reshape(width, width) / n
    return (out + out.T) / 2


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n * x - S) ** 2, exact; null where it does not fit a long."""
    base = total // n
    near, rest = x - base, total - base * n
    if float(n) * float(np.abs(near).max(initial=0)) < 2.0**61:
        step = n * near - rest
        if float(np.abs(step).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return pa.array((step * step).sum(axis=1))
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in near.tolist()]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component (from 1): vec_id, component, n (different vectors), deviation, whitened,
    explained (share of the variance) and identity_error (largest entry by which the covariance of the whitened
    vectors differs from the identity).

    Vectors that are null or hold null or non-finite entries take no part, nor do entries beyond 2 ** 45 and vectors of
    another length than most (the longer one where two are as common). Components without variance (one vector, or vectors
    that span less) have no rows. Repeated rows each get theirs; ids may be null or repeat; an empty table gives no rows;
    other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = integer_vectors(vectors, id_col, vector_col)
    schema = OUT.format(kind=vectors.schema[id_col].dataType.simpleString())
    fit = settle(rows.select("x").distinct(), "whitening-fit")
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    if not dim:
        return spark.createDataFrame([], schema)
    rows, fit = rows.filter(F.size("x") == dim), fit.filter(F.size("x") == dim)
    total, n = np.zeros(dim, dtype=np.int64), 0
    for row in fit.mapInArrow(_sums(dim), "at int, part long, n long").groupBy("at").agg(F.sum("part").alias("s"), F.sum("n").alias("n")).collect():
        total[row["at"]], n = row["s"], row["n"]  # one row per dimension
    base = total // n
    rest = (total - base * n) / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base) - rest

    cov = _covariance(fit, n, dim, dim, centred)
    values, axes = leading(cov, min(components, dim))
    trace = float(np.trace(cov))
    real = values > max(trace, 0.0) * dim * 1e-14
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    scaled, count = axes / np.sqrt(values), len(values)
    error = float(np.abs(_covariance(fit, n, dim, count, lambda x: centred(x) @ scaled) - np.eye(count)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                m = part.num_rows
                x = _matrix(part.column(1), dim)
                each = pa.array(np.repeat(np.arange(m), count))
                out = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n)),
                    deviations(x, n, total).take(each), pa.array((centred(x) @ scaled).ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * count, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_feast_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(documents(spark, sf_dir, "embeddings"))
