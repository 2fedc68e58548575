"""What several of these operators share: Arrow slices of bounded size, ranks without a hot task, shared scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from channelgraph.session import drop_settled, scratch_path, settle, ship_package

__all__ = ["byte_slices", "documents", "drop_settled", "md5_key", "ranked", "scratch_path", "settle", "ship_package", "utf8"]

RANK_BUCKETS = 1024


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A whole table, with the package made known to the executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The strings of an Arrow column as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).fill_null(b"")


def byte_slices(table: pa.Table | pa.RecordBatch, column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose bytes in a binary column add up to about ``most``; a longer row comes alone."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    a, rows = 0, len(column)
    while a < rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, min(b, rows)
        a = min(b, rows)


def md5_key(seed: str, *columns: str | Column) -> Column:
    """32 hexadecimal digits that depend on the seed and the columns; they sort like a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]))


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """Rank from 1 within each group, and the group's size, with no task that holds a whole group.

    ``bucket`` is a number from 0 to RANK_BUCKETS - 1 that never falls along ``order``. Buckets are counted first (with
    partial sums), each starts after the sum of those before it, and only rows of one bucket are sorted together.
    ``df`` is read twice and should be settled.
    """
    df = df.withColumn("_bucket", bucket.cast("int"))
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    starts = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(
            *[F.col(k).alias(f"_s_{k}") for k in keys],
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
            F.sum("_n").over(whole).alias(total),
        )
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn(rank, F.row_number().over(within))
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    joined = rows.join(starts, same)
    return joined.withColumn(rank, F.col(rank) + F.col("_start")).drop("_bucket", "_start", *[f"_s_{k}" for k in keys])
