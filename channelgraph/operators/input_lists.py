"""Image scores that follow added and deleted example inputs without a full recount.

For every image the inputs closest to it are kept, with a floor that no input outside the list rises above. An added input
is compared with each image once and takes its place in the lists; a deleted one is struck out of them. Only images
whose list has run out are compared with all inputs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.scores import ScopeParams, relevance
from channelgraph.operators.knn import best_first, best_inputs
from channelgraph.session import settle

KEPT = 8
LISTS = "phash string, best array<struct<s: double, input: bigint>>, floor double"


def build(vectors: DataFrame, inputs: DataFrame, kept: int = KEPT) -> DataFrame:
    """phash, best (the ``kept`` closest inputs, best first), floor (null where the list holds all inputs).

    One row per image with a valid vector; no rows without inputs.
    """
    found = best_inputs(vectors, inputs, "phash", kept + 1)
    if found is None:
        return vectors.sparkSession.createDataFrame([], LISTS)
    return settle(_cut(found.withColumn("floor", F.lit(None).cast("double")), kept), "input-lists")


def _cut(rows: DataFrame, kept: int) -> DataFrame:
    """The certain part of each list, ``kept`` long at most, and the floor that what is left out sets."""
    certain = F.filter("best", lambda p: F.col("floor").isNull() | (p["s"] >= F.col("floor")))
    rows = rows.withColumn("_kept", F.slice(certain, 1, kept))
    left_out = F.get("best", F.size("_kept"))["s"]
    return rows.select("phash", F.col("_kept").alias("best"), F.greatest("floor", left_out).alias("floor"))


def add(lists: DataFrame, vectors: DataFrame, inputs: DataFrame, added: DataFrame, kept: int = KEPT) -> DataFrame:
    """The lists with ``added`` inputs in them. ``inputs`` are those there were before, for images that have no list yet."""
    fresh = best_inputs(vectors, added, "phash", kept + 1)
    if fresh is None:
        return lists
    fresh = settle(fresh.withColumnRenamed("best", "more"), "input-lists")
    joined = lists.join(fresh, "phash")
    merged = joined.withColumn("best", best_first(F.concat("best", "more")))
    known = _cut(merged.select("phash", "best", "floor"), kept)
    new = vectors.join(fresh.join(lists.select("phash"), "phash", "left_anti").select("phash"), "phash", "left_semi")
    if new.isEmpty():
        return settle(known, "input-lists")
    both = inputs.select("id", "embedding").unionByName(added.select("id", "embedding"))
    return settle(known.unionByName(build(new, both, kept)), "input-lists")


def remove(lists: DataFrame, vectors: DataFrame, left: DataFrame, gone: DataFrame, kept: int = KEPT) -> DataFrame:
    """The lists without the inputs ``gone`` (id). ``left`` are the inputs that stay, for images whose list has run out."""
    struck = lists.withColumn("_gone", gone.agg(F.collect_set(F.col("id").cast("long"))).scalar())
    struck = struck.withColumn("best", F.filter("best", lambda p: ~F.array_contains("_gone", p["input"])))
    struck = settle(struck.select("phash", "best", "floor"), "input-lists")
    empty = (F.size("best") == 0) & F.col("floor").isNotNull()
    out = struck.filter(empty).select("phash")
    if out.isEmpty():
        return struck
    again = build(vectors.join(out, "phash", "left_semi"), left, kept)
    return settle(struck.filter(~empty).unionByName(again), "input-lists")


def scores(lists: DataFrame, params: ScopeParams = ScopeParams()) -> DataFrame:
    """phash, s, r, version as ``scope.image_scores`` gives them; images without any input have none."""
    s = F.get("best", F.lit(0))["s"]
    known = lists.filter(F.size("best") > 0).select("phash", s.alias("s"))
    return known.select("phash", "s", relevance(F.col("s"), params).alias("r"), F.lit(params.version).alias("version"))
