"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelgraph.session import settle


def ranked_within(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place from 1 of each row in its group, in a total order.

    Rows are laid out in ranges of (group, order), so that a large group lies in several; each range numbers its own rows, and
    begins after the rows of its group in the ranges before. Only one count for each group and range is brought together.
    Without groups the whole table is ranked.
    """
    keys = groups or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    laid = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    laid = settle(laid.withColumn("_range", F.spark_partition_id()), "ranked")
    counts = laid.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("_range").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    ranked = laid.withColumn(name, own).join(starts, [*same, F.col("_range") == F.col("_in")])
    return ranked.withColumn(name, F.col(name) + F.col("_start")).select(*[c for c in df.columns if c != "_all"], name)
