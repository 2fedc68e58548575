"""Shards that all have the mixture of the whole: proportional stratified interleaving, in DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; the r-th of n rows stands at (2r - 1) / 2n. Sorted by that
fraction, every stretch of the order has the sources in their shares, so cutting it into equal runs gives shards of the
same mixture whose row counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import RANK_BUCKETS, md5_key, ranked, settle
from channelgraph.operators.ranking import ranked_within


def _hex_bucket(key: str) -> Column:
    """The first ten bits of a hash in hexadecimal digits."""
    return F.floor(F.conv(F.substring(key, 1, 3), 16, 10).cast("int") / (4096 // RANK_BUCKETS))


def interleave(docs: DataFrame, shards: int, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size (UTF-8 bytes + 1), text_crc32, shard and slot.

    Null text has size 1 and the checksum of no bytes; a null source is a source of its own. Repeated rows each get a
    place; rows that agree in id, text and source may swap places, which cannot be seen. A very long text is read where it
    is, only its size and checksum move. An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            md5_key(seed, id_col).alias("key"),
        ),
        "shard-rows",
    )
    tie = ["key", "doc_id", "size", "text_crc32"]
    placed = ranked(narrow, ["source"], _hex_bucket("key"), tie, "rank", "n_source")
    placed = settle(placed.withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("n_source"))), "shard-fractions")
    # ranges of the whole order: rows of equal fraction (all sources of one row have one half) lie in several
    cut = ranked_within(placed, [], [F.col("fraction"), F.col("source").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tie]], "place")
    cut = cut.withColumn("n_all", F.lit(placed.count()))
    place = F.col("place") - 1
    cut = cut.withColumn("shard", F.floor(place * shards / F.col("n_all")).cast("int"))
    # the first place p of shard s is the smallest with p * shards >= s * n
    first = F.floor((F.col("shard") * F.col("n_all") + shards - 1) / shards).cast("long")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (place - first).cast("long").alias("slot"))


def op4_stratified_shards(spark, sf_dir: str) -> DataFrame:
    from channelgraph.llm.common import documents

    return interleave(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
