"""Roll-ups of videos and files over the messages that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channelgraph.functions.media import digits_or_null, is_persisted, media_item_id, media_kind

def media_items(messages: DataFrame, kind: str, peer: int | None = None) -> DataFrame:
    """Messages of one kind with the id of the item they carry, without their text.

    With ``peer``, the items that the peer posted, wherever they appear.
    """
    media = F.col("media")
    items = messages.filter(media_kind(media) == kind).select(
        media_item_id(media, F.col("id")).alias("item_id"),
        "id",
        "peer_external_id",
        "telegram_message_id",
        "date",
        "media",
        F.col("fwd_from").isNotNull().alias("forwarded"),
    )
    if peer is None:
        return items
    posted = items.filter(F.col("peer_external_id") == peer).select("item_id").distinct()
    return items.join(posted, "item_id", "left_semi")


def _rollup(items: DataFrame, columns: dict) -> DataFrame:
    """Two steps, per item and peer and then per item, so that a much-shared item is no single task's work."""
    per_peer = items.groupBy("item_id", "peer_external_id").agg(
        *[F.max(c).alias(name) for name, c in columns.items()],
        F.max(is_persisted(F.col("media"))).alias("persisted"),
        F.count("*").alias("n"),
        F.max("date").alias("last"),
    )
    return per_peer.groupBy("item_id").agg(
        *[F.max(name).alias(name) for name in columns],
        F.max("persisted").alias("persisted"),
        F.sum("n").alias("appearances"),
        F.count("peer_external_id").alias("unique_peers"),
        F.max("last").alias("last_seen_at"),
    )


def video_rollup(messages: DataFrame, peer: int | None = None) -> DataFrame:
    """One row per video: largest stated size and dimensions, whether stored, appearances, peers, last date."""
    media = F.col("media")
    return _rollup(
        media_items(messages, "video", peer),
        {
            "size_bytes": digits_or_null(media["size_bytes"]),
            "mime_type": media["mime_type"],
            "file_name": media["file_name"],
            "duration": digits_or_null(media["duration"], "double"),
            "width": digits_or_null(media["width"]),
            "height": digits_or_null(media["height"]),
        },
    )


def file_rollup(messages: DataFrame, peer: int | None = None) -> DataFrame:
    """One row per file that is neither image, video nor sound."""
    media = F.col("media")
    return _rollup(
        media_items(messages, "document", peer),
        {
            "size_bytes": digits_or_null(media["size_bytes"]),
            "mime_type": media["mime_type"],
            "file_name": media["file_name"],
        },
    )


def item_order() -> list:
    return [F.desc_nulls_last("last_seen_at"), F.asc("item_id")]


def item_peers(messages: DataFrame, kind: str, peer: int | None = None) -> DataFrame:
    """Per item and peer: appearances, how many forwarded, last date. Items of a single message need no own case."""
    return (
        media_items(messages, kind, peer)
        .groupBy("item_id", "peer_external_id")
        .agg(
            F.count("*").alias("appearances"),
            F.count(F.when(F.col("forwarded"), 1)).alias("forwarded"),
            F.max("date").alias("last_seen_at"),
        )
    )


def with_peer_names(fan: DataFrame, peers: DataFrame) -> DataFrame:
    """Fan-out rows with type, title and handles; peers that are not catalogued drop out."""
    side = peers.select(
        F.col("external_id").alias("peer_external_id"), "peer_type", F.col("title").alias("peer_title"),
        F.col("username").alias("peer_username"), F.col("usernames").alias("peer_usernames"),
    )
    return fan.join(side, "peer_external_id")


def newest_sources(rows: DataFrame, key: str, date: str, tie: str, k: int) -> DataFrame:
    """The newest ``k`` rows per key. Spark limits each task's groups to ``k`` rows before the shuffle."""
    newest_first = Window.partitionBy(key).orderBy(F.desc_nulls_last(date), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= k)


def media_sources(messages: DataFrame, kind: str, k: int) -> DataFrame:
    """Messages a video or file can be fetched from."""
    items = media_items(messages, kind).select("item_id", "id", "peer_external_id", "telegram_message_id", "date")
    return newest_sources(items, "item_id", "date", "id", k)


def image_sources(links: DataFrame, k: int) -> DataFrame:
    """Messages an image can be fetched from."""
    usable = links.filter(F.col("telegram_message_id").isNotNull())
    return newest_sources(usable, "phash", "message_date", "message_id", k)
