"""Exports of peers, edges, messages and media as flat tables ready for a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.forwards import fwd_name, fwd_origin
from channelgraph.functions.media import media_kind
from channelgraph.functions.predicates import export_scope
from channelgraph.functions.text import restriction_csv, usernames_csv
from channelgraph.operators.forwards import edge_titles
from channelgraph.operators.images import image_peers, image_rollup, images_of_peer
from channelgraph.operators.listing import attach_stats, first_phash, with_peer
from channelgraph.operators.rollups import file_rollup, item_peers, video_rollup, with_peer_names
from channelgraph.operators.texts import with_texts
from channelgraph.schemas import PEER_TYPES
from channelgraph.sources.sinks import write_csv, write_json

# Column orders of the export files.
PEER_COLUMNS = [
    "external_id", "peer_type", "title", "first_name", "last_name", "username", "usernames", "about",
    "telegram_date", "created_at", "updated_at", "last_message_at", "participants_count", "posts",
    "forwards_unique", "forwards_total", "images_unique", "images_persisted", "videos_total", "videos_downloaded",
    "audio_total", "gif_total", "document_total", "verified", "scam", "fake", "restricted", "restriction_reason",
    "noforwards", "forum", "gigagroup", "join_to_send", "join_request", "has_link", "has_geo", "deleted",
    "premium", "deactivated", "slowmode_enabled", "slowmode_seconds", "hidden_prehistory", "available_min_id",
    "participants_hidden", "admins_count", "kicked_count", "banned_count", "online_count", "ttl_period",
    "pinned_msg_id", "linked_chat_id", "linked_monoforum_id", "migrated_from_chat_id", "migrated_to_channel_id",
    "location_address", "location_lat", "location_lng", "common_chats_count", "has_fetch_coverage", "embed_text",
    "embed_images", "videos_excluded", "large_excluded", "max_media_bytes",
]
EDGE_COLUMNS = [
    "from_external_id", "from_peer_type", "from_title", "from_username", "to_external_id", "to_peer_type",
    "to_title", "to_username", "last_from_name", "forward_count", "first_seen_at", "last_seen_at",
]
MESSAGE_COLUMNS = [
    "id", "telegram_message_id", "date", "peer_external_id", "peer_type", "peer_title", "peer_username",
    "peer_usernames", "from_external_id", "content", "forwarded", "fwd_from_peer_id", "fwd_from_name",
    "media_kind", "media_document_id", "media_mime_type", "media_file_name", "media_size_bytes",
    "media_duration", "media_width", "media_height", "image_phash", "text_embedded", "image_embedded",
]
IMAGE_COLUMNS = ["phash", "appearances", "unique_peers", "last_seen_at", "persisted", "refcount"]
VIDEO_COLUMNS = [
    "video_id", "file_name", "mime_type", "size_bytes", "duration", "width", "height", "appearances",
    "unique_peers", "last_seen_at", "persisted",
]
FILE_COLUMNS = [
    "file_id", "file_name", "mime_type", "size_bytes", "appearances", "unique_peers", "last_seen_at", "persisted",
]
FAN_COLUMNS = ["peer_external_id", "peer_type", "peer_title", "peer_username", "peer_usernames", "appearances", "forwarded"]


def save(rows: DataFrame, path: str, order: list[Column], fmt: str = "csv", partition: str | None = None) -> None:
    """Write an export in its order. Sorting by range spreads a big export over many files, in order of their names.

    ``partition`` gives one folder per value, as for one file per peer type.
    """
    ordered = rows.orderBy(*order)
    if fmt == "json":
        write_json(ordered, path, partition)
    else:
        write_csv(ordered, path, rows.columns, partition)


def peer_types(wanted: list[str] | None) -> list[str]:
    """The known types among those asked for; all of them if none is left."""
    return [t for t in wanted or [] if t in PEER_TYPES] or list(PEER_TYPES)


def _ratio(bucket: str) -> Column:
    b = F.col(bucket)
    return F.when(b.isNotNull(), F.concat_ws("/", b["done"].cast("string"), b["total"].cast("string")))


def export_peers(
    peers: DataFrame, counts: DataFrame, fetch: DataFrame, media: DataFrame, types: list[str] | None = None
) -> DataFrame:
    """The flat peer table of 63 columns."""
    chosen = peers.filter(F.col("peer_type").isin(*peer_types(types)))
    rows = attach_stats(chosen, counts, fetch, media)
    m = F.col("media")
    flat = {
        "usernames": usernames_csv(F.col("usernames")),
        "restriction_reason": restriction_csv(F.col("restriction_reason")),
        "images_unique": m["image"]["unique"],
        "images_persisted": m["image"]["downloaded"],
        "videos_total": m["video"]["total"],
        "videos_downloaded": m["video"]["downloaded"],
        "audio_total": m["audio"]["total"],
        "gif_total": m["gif"]["total"],
        "document_total": m["document"]["total"],
        "embed_text": _ratio("embed_text"),
        "embed_images": _ratio("embed_images"),
    }
    return rows.select(*[flat.get(c, F.col(c)).alias(c) for c in PEER_COLUMNS])


def peer_export_order() -> list[Column]:
    return [F.desc("created_at"), F.desc("external_id")]


def export_forward_edges(edges: DataFrame, peers: DataFrame, posters: DataFrame | None = None) -> DataFrame:
    """Edges with titles and handles; ``posters`` (external_id) keeps those that start there."""
    if posters is not None:
        edges = edges.join(
            posters.select(F.col("external_id").alias("from_external_id")), "from_external_id", "left_semi"
        )
    return edge_titles(edges, peers).select(*EDGE_COLUMNS)


def edge_export_order() -> list[Column]:
    return [F.desc("forward_count"), F.asc("from_external_id"), F.asc("to_external_id")]


def _export_rows(messages: DataFrame, peers: DataFrame, links: DataFrame, scope: dict, texts: DataFrame | None) -> DataFrame:
    """Messages in scope with their peer and first image hash.

    Peer and hash are found for bare ids first, so that the text is moved once, by id, and not by a hot peer. ``texts``
    (text_id, content) resolves references, last.
    """
    linked = first_phash(links).withColumnsRenamed({"message_id": "id", "link_phash": "image_phash"})
    chosen = messages.filter(export_scope(**scope, columns=messages.columns))
    slim = with_peer(chosen.select("id", "peer_external_id"), peers).join(linked, "id", "left")
    rows = chosen.drop("peer_external_id").join(slim, "id")
    return rows if texts is None else with_texts(rows, texts)


def _media_text(name: str) -> Column:
    return F.nullif(F.col(f"media.{name}"), F.lit(""))


def export_messages(
    messages: DataFrame, peers: DataFrame, links: DataFrame, forwards: bool = True, texts: DataFrame | None = None, **scope
) -> DataFrame:
    """The flat message table of 24 columns."""
    fwd = F.col("fwd_from")
    origin = fwd_origin(fwd) if forwards else F.lit(None).cast("bigint")
    name = fwd_name(fwd) if forwards else F.lit(None).cast("string")
    flat = {
        "peer_usernames": usernames_csv(F.col("peer_usernames")),
        "forwarded": fwd.isNotNull(),
        "fwd_from_peer_id": origin,
        "fwd_from_name": name,
        "media_kind": media_kind(F.col("media")),
        "text_embedded": F.coalesce("text_embedded", F.lit(False)),
        "image_embedded": F.coalesce("image_embedded", F.lit(False)),
    }
    for c in ("document_id", "mime_type", "file_name", "size_bytes", "duration", "width", "height"):
        flat[f"media_{c}"] = _media_text(c)
    rows = _export_rows(messages, peers, links, scope, texts)
    return rows.select(*[flat.get(c, F.col(c)).alias(c) for c in MESSAGE_COLUMNS])


def message_export_order() -> list[Column]:
    return [
        F.asc_nulls_last("peer_title"), F.asc("peer_external_id"), F.asc("date"), F.asc("telegram_message_id")
    ]


def export_messages_nested(
    messages: DataFrame, peers: DataFrame, links: DataFrame, forwards: bool = True, texts: DataFrame | None = None, **scope
) -> tuple[DataFrame, DataFrame]:
    """Peer headers with their number of messages, and one nested record per message.

    A busy channel can hold a large share of all messages, so they are never gathered into one value per peer:
    sorted by peer and date they lie together in the output, one line each.
    """
    rows = _export_rows(messages, peers, links, scope, texts)
    fwd, kind = F.col("fwd_from"), media_kind(F.col("media"))
    media = F.struct(
        kind.alias("kind"),
        *[_media_text(c).alias(c) for c in ("document_id", "mime_type", "file_name", "size_bytes", "duration", "width", "height")],
        F.col("image_phash").alias("phash"),
    )
    forward = F.struct(fwd_origin(fwd).alias("from_peer_id"), fwd_name(fwd).alias("from_name"))
    records = rows.select(
        "peer_external_id", "peer_title", F.col("id").cast("string").alias("id"), "telegram_message_id", "date",
        "from_external_id", "content",
        F.when(F.lit(forwards) & fwd.isNotNull(), forward).alias("forward"),
        F.when(kind.isNotNull(), media).alias("media"), "text_embedded", "image_embedded",
    )
    counted = (
        messages.filter(export_scope(**scope, columns=messages.columns))
        .groupBy(F.col("peer_external_id").alias("external_id"))
        .agg(F.count("*").alias("messages"))
    )
    headers = peers.select("external_id", "peer_type", "title", "username", "usernames").join(counted, "external_id")
    return headers, records


def _named_fan(fan: DataFrame, peers: DataFrame, key: str) -> DataFrame:
    named = with_peer_names(fan, peers).withColumn("peer_usernames", usernames_csv(F.col("peer_usernames")))
    return named.select(key, *FAN_COLUMNS)


def export_images(
    blobs: DataFrame, links: DataFrame, messages: DataFrame, peers: DataFrame, peer: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Images and the peers they appear in."""
    rows = image_rollup(blobs, links, peer).withColumn(
        "persisted", F.coalesce(F.col("canonical_path") != "", F.lit(False))
    )
    shown = links if peer is None else links.join(images_of_peer(links, peer), "phash", "left_semi")
    return rows.select(*IMAGE_COLUMNS), _named_fan(image_peers(shown, messages), peers, "phash")


def export_videos(messages: DataFrame, peers: DataFrame, peer: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Videos and the peers they appear in. Durations are cut to whole seconds."""
    rows = video_rollup(messages, peer).withColumn("duration", F.col("duration").cast("bigint"))
    fan = _named_fan(item_peers(messages, "video", peer), peers, "item_id")
    return (
        rows.withColumnRenamed("item_id", "video_id").select(*VIDEO_COLUMNS),
        fan.withColumnRenamed("item_id", "video_id"),
    )


def export_files(messages: DataFrame, peers: DataFrame, peer: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files and the peers they appear in."""
    fan = _named_fan(item_peers(messages, "document", peer), peers, "item_id")
    return (
        file_rollup(messages, peer).withColumnRenamed("item_id", "file_id").select(*FILE_COLUMNS),
        fan.withColumnRenamed("item_id", "file_id"),
    )

