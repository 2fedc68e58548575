"""Following forwards outward from seeds, and which peer to take next."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.ids import is_target
from channelgraph.session import scratch_path


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Peers reached from ``seeds`` (peer_id) along edges from poster to origin, each once at its least depth.

    ``via`` is the peer that led there, the lowest id where several did. ``max_depth`` 0 gives the seeds alone,
    ``None`` goes on until nothing new turns up. Every round is written to the shared folder as one partition of the
    visited table, so plans stay short and a lost executor costs at most the running round. The edges are filtered and
    dealt out by poster once, into buckets; a round then moves its frontier only.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "expand")
    lines = edges.select(
        F.col("from_external_id").alias("peer_id"), F.col("to_external_id").alias("next")
    ).filter(is_target(F.col("next")))
    table = f"expand_{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines.write.bucketBy(parts, "peer_id").sortBy("peer_id").option("path", f"{path}-lines").saveAsTable(table)
    lines = spark.table(table)
    schema = "peer_id bigint, via bigint, depth int"
    try:
        seeds.select("peer_id", F.lit(None).cast("bigint").alias("via")).distinct().write.parquet(f"{path}/depth=0")
        depth = 0
        while max_depth is None or depth < max_depth:
            visited = spark.read.schema(schema).parquet(path)
            frontier = visited.filter(F.col("depth") == depth).select("peer_id")
            found = (
                lines.join(frontier, "peer_id")
                .groupBy("next")
                .agg(F.min("peer_id").alias("via"))
                .withColumnRenamed("next", "peer_id")
                .join(visited.select("peer_id"), "peer_id", "left_anti")
            )
            depth += 1
            found.write.parquet(f"{path}/depth={depth}")
            if spark.read.schema("peer_id bigint").parquet(f"{path}/depth={depth}").isEmpty():
                break
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return spark.read.schema(schema).parquet(path)


def frontier_order(use_scope: bool) -> list[Column]:
    """Retries first, then seeds, then by forward score with the larger id winning ties, or in order of discovery."""
    tries = F.coalesce("retry", F.lit(False)).desc()
    seed = (F.col("depth") == 0).desc()
    fixed = F.coalesce("retry", F.lit(False)) | (F.col("depth") == 0)
    fifo = F.when(fixed, F.col("seq")).asc_nulls_last()
    if not use_scope:
        return [tries, seed, F.col("seq").asc()]
    return [tries, seed, fifo, F.col("forward_score").desc(), F.col("peer_id").desc()]


def rank_frontier(frontier: DataFrame, peers: DataFrame, use_scope: bool, k: int) -> DataFrame:
    """The next ``k`` of the frontier (peer_id, depth, retry, seq); one is what a sequential walk would take."""
    scores = peers.select(
        F.col("external_id").alias("peer_id"), F.coalesce("forward_score", F.lit(0.0)).alias("forward_score")
    )
    scored = frontier.join(scores, "peer_id", "left").fillna(0.0, ["forward_score"])
    return scored.orderBy(*frontier_order(use_scope)).limit(k)
