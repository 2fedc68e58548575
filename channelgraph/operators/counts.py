"""Per-peer counters: full recount, insert deltas and their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.media import (
    format_bytes,
    has_phash,
    is_downloaded,
    media_item_id,
    media_kind,
)
from channelgraph.functions.text import has_words, stored_has_text
from channelgraph.operators.images import blob_flags
from channelgraph.schemas import COUNT_COLUMNS, MEDIA_KINDS


def _flags(kind: Column, downloaded: Column, text: Column) -> dict[str, Column]:
    out = {"posts": F.lit(True), "text_total": text}
    for name in MEDIA_KINDS:
        out[f"{name}_total"] = kind == name
        out[f"{name}_downloaded"] = (kind == name) & downloaded
    return out


def _counted(flags: dict[str, Column]) -> list[Column]:
    return [F.count(F.when(test, 1)).alias(name) for name, test in flags.items()]


def with_kind(messages: DataFrame, *keep: str) -> DataFrame:
    """The few facts counting needs, so that no text is carried further."""
    media = F.col("media")
    return messages.select(
        *keep,
        media_kind(media).alias("kind"),
        is_downloaded(media).alias("downloaded"),
        has_phash(media).alias("hashed"),
        stored_has_text(messages.columns).alias("text"),
    )


def message_counts(messages: DataFrame) -> DataFrame:
    facts = with_kind(messages, "peer_external_id", "text_embedded")
    flags = _flags(F.col("kind"), F.col("downloaded"), F.col("text"))
    flags["text_embedded"] = F.col("text") & F.col("text_embedded")
    flags["image_hashed"] = (F.col("kind") == "image") & F.col("hashed")
    return facts.groupBy("peer_external_id").agg(*_counted(flags))


def image_counts(links: DataFrame, blobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct images per peer. Pairs are made distinct before the registry is joined."""
    pairs = links.filter(F.col("peer_external_id").isNotNull()).select("peer_external_id", "phash").distinct()
    known = blob_flags(blobs, cache, trim_paths=False).withColumn("known", F.lit(True))
    return (
        pairs.join(known, "phash", "left")
        .groupBy("peer_external_id")
        .agg(
            *_counted(
                {
                    "image_unique": F.col("known"),
                    "image_persisted": F.col("persisted"),
                    "image_embeddable": F.col("embeddable"),
                    "image_embedded_unique": F.col("embedded"),
                }
            )
        )
    )


def edge_totals(edges: DataFrame) -> DataFrame:
    """Per poster: how many origins it forwards from, and how often."""
    return edges.groupBy(F.col("from_external_id").alias("peer_external_id")).agg(
        F.count("*").alias("unique_forwards"), F.coalesce(F.sum("forward_count"), F.lit(0)).alias("total_forwards")
    )


def peer_counts(
    messages: DataFrame, links: DataFrame, blobs: DataFrame, cache: DataFrame, edges: DataFrame
) -> DataFrame:
    """All twenty counters for every peer that posts, shows an image or forwards.

    The three partial tables are stacked and summed: the union of their keys is the spine, and no join is needed.
    """
    parts = [message_counts(messages), image_counts(links, blobs, cache), edge_totals(edges)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy("peer_external_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNT_COLUMNS]
    )


def insert_facts(messages: DataFrame, *keep: str) -> DataFrame:
    """What counts about a new message. Text is what remains after all white space is stripped."""
    media = F.col("media")
    return messages.select(
        "peer_external_id",
        *keep,
        media_kind(media).alias("kind"),
        is_downloaded(media).alias("downloaded"),
        has_words(messages.columns).alias("text"),
    )


def message_deltas(messages: DataFrame) -> DataFrame:
    """Counters that new messages add, per peer."""
    return sum_facts(insert_facts(messages))


def sum_facts(facts: DataFrame) -> DataFrame:
    flags = _flags(F.col("kind"), F.col("downloaded"), F.col("text"))
    return facts.groupBy("peer_external_id").agg(*_counted(flags))


def apply_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add deltas to stored counters; nothing falls below zero."""
    given = [c for c in COUNT_COLUMNS if c in deltas.columns]
    old, new = counts.alias("o"), deltas.select("peer_external_id", *given).alias("d")

    def summed(c: str) -> Column:
        base = F.coalesce(F.col(f"o.{c}"), F.lit(0))
        if c not in given:
            return base.alias(c)
        return F.greatest(base + F.coalesce(F.col(f"d.{c}"), F.lit(0)), F.lit(0)).alias(c)

    return old.join(new, "peer_external_id", "full_outer").select(
        "peer_external_id", *[summed(c) for c in COUNT_COLUMNS]
    )


def kind_histogram(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Messages by media kind over a set of peers, one row."""
    chosen = messages.join(peers.select("peer_external_id"), "peer_external_id", "left_semi")
    kinds = chosen.select(media_kind(F.col("media")).alias("kind"))
    return kinds.agg(
        F.count("*").alias("messages"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in MEDIA_KINDS]
    )


def catalog_totals(messages: DataFrame, counts: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row of totals over the whole archive."""
    media = F.col("media")
    videos = messages.filter(
        (media_kind(media) == "video") & is_downloaded(media) & F.coalesce(F.trim(media["path"]) != "", F.lit(False))
    )
    items = videos.select(media_item_id(media, F.col("id")).alias("item")).distinct().agg(F.count("*"))
    paths = videos.select("media.path").distinct().agg(F.count("*"))
    posts = counts.agg(F.coalesce(F.sum("posts"), F.lit(0)))
    hashed = blobs.agg(F.count("*"))
    stored = blobs.agg(F.count(F.when(F.trim("canonical_path") != "", 1)))
    return messages.sparkSession.range(1).select(
        posts.scalar().alias("messages"),
        hashed.scalar().alias("images_hashed"),
        stored.scalar().alias("images_downloaded"),
        items.scalar().alias("videos_downloaded"),
        paths.scalar().alias("video_paths"),
    )


def storage_bytes(files: DataFrame, prefix_depth: int = 1) -> DataFrame:
    """Bytes and files per top folder, from a listing with ``path`` and ``length``."""
    top = F.element_at(F.split("path", "/"), -(prefix_depth + 1)).alias("folder")
    sums = files.groupBy(top).agg(F.count("*").alias("count"), F.sum("length").alias("bytes"))
    return sums.withColumn("bytes_label", F.coalesce(format_bytes(F.col("bytes")), F.lit("0 B")))
