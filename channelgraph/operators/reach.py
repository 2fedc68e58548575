"""Everything that forwards lead to, round by round, with the visited peers as bitmaps.

Peers get dense numbers in the order of their ids, so the lowest id and the lowest number are the same peer. Edges between
numbers are laid out by poster once. What has been visited is one bitmap for each 32 768 numbers, an eighth of a byte for a
peer: a round joins its frontier with the edges and looks what it found up in the bitmaps, and the peers visited before are
neither read nor moved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.ids import is_target
from channelgraph.operators.ranking import ranked_within
from channelgraph.session import drop_settled, scratch_path, settle


def bitmaps(numbers: DataFrame) -> DataFrame:
    """part, bits: the given numbers as one bitmap for each 32 768."""
    return numbers.groupBy(F.bitmap_bucket_number("number").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def has_bit(bits: Column, number: Column) -> Column:
    """Whether the bitmap of a number's part holds it; a part without a bitmap holds none."""
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """peer_id, via and depth as :func:`channelgraph.operators.expand.expand` gives them.

    Peers reached from ``seeds`` (peer_id) along edges from poster to origin, each once at its least depth; ``via`` is the
    lowest id among those that led there. Null seeds lead nowhere and are left out. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    lines = edges.select(F.col("from_external_id").alias("a"), F.col("to_external_id").alias("b")).filter(is_target(F.col("b")) & F.col("a").isNotNull())
    start = seeds.select("peer_id").filter(F.col("peer_id").isNotNull()).distinct()
    peers = lines.select(F.explode(F.array("a", "b")).alias("peer_id")).unionByName(start).distinct()
    numbered = settle(ranked_within(peers, [], [F.col("peer_id")], "number"), "reach-numbers")
    by_number = lines.join(numbered.select(F.col("peer_id").alias("a"), F.col("number").alias("source")), "a")
    by_number = by_number.join(numbered.select(F.col("peer_id").alias("b"), F.col("number").alias("target")), "b")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"reach_{uuid.uuid4().hex}"
    laid = by_number.select("source", "target").distinct().repartition(parts, "source")
    laid.write.bucketBy(parts, "source").sortBy("source").option("path", scratch_path(spark, "reach-edges")).saveAsTable(table)
    try:
        return _rounds(spark.table(table), start, numbered, max_depth)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _rounds(by_number: DataFrame, start: DataFrame, numbered: DataFrame, max_depth: int | None) -> DataFrame:
    """Round after round over edges (source, target) in buckets by source; a round moves its frontier only."""
    spark = by_number.sparkSession
    path, schema = scratch_path(spark, "reach"), "number bigint, via bigint, depth int"

    def written(found: DataFrame, depth: int) -> DataFrame:
        found.select("number", "via").write.parquet(f"{path}/depth={depth}")
        return spark.read.schema("number bigint, via bigint").parquet(f"{path}/depth={depth}")

    first = start.join(numbered, "peer_id").select("number", F.lit(None).cast("bigint").alias("via"))
    frontier = written(first, 0)
    visited = settle(bitmaps(frontier), "reach-visited")
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        met = by_number.join(frontier.select(F.col("number").alias("source")), "source")
        met = met.groupBy(F.col("target").alias("number")).agg(F.min("source").alias("via"))
        known = met.withColumn("part", F.bitmap_bucket_number("number")).join(visited, "part", "left")
        depth += 1
        frontier = written(known.filter(~has_bit(F.col("bits"), F.col("number"))), depth)
        both = visited.unionByName(bitmaps(frontier)).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
        merged = settle(both, "reach-visited")
        drop_settled(visited)
        visited = merged
    names = numbered.select("number", "peer_id")
    found = spark.read.schema(schema).parquet(path).join(names, "number")
    vias = numbered.select(F.col("number").alias("via"), F.col("peer_id").alias("via_id"))
    return found.join(vias, "via", "left").select("peer_id", F.col("via_id").alias("via"), "depth")
