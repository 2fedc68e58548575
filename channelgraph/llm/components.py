"""Connected components of a link table, by alternating star rounds; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import drop_settled, settle


def _lowest(sides: DataFrame) -> DataFrame:
    """For each u, the least of u and its neighbours v."""
    return sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Links have u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_lowest(both), F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = settle(large.filter("u > v").distinct(), "components-large")
    joined = large.join(_lowest(large), F.col("u") == F.col("at"))
    sides = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    small = settle(joined.select(sides.alias("s")).select("s.u", "s.v").filter("u > v").distinct(), "components-small")
    drop_settled(large)
    return small


def _mark(links: DataFrame) -> tuple:
    """A number that two equal link tables share."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is the least node that it reaches. ``links``: u and v, both long, in any
    direction; loops and repeats do no harm. The number of rounds grows with the logarithm of the longest chain."""
    now = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settle(now, "components-links")
    mark = _mark(now)
    while True:
        then = now
        now = _round(then)
        drop_settled(then)
        if mark == (mark := _mark(now)):
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return settle(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components-roots")
