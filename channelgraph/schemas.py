"""Fixed schemas of the archive tables."""

from __future__ import annotations

from pyspark.sql import types as T

_long, _int, _str, _bool, _dbl = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType()
_ts = T.TimestampNTZType()
_vector = T.ArrayType(T.FloatType(), True)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Ids stay text inside the header because a header may carry a malformed one.
_FWD_PEER = T.StructType(
    [T.StructField(name, _str) for name in ("_", "tl", "channel_id", "chat_id", "user_id")]
)
FWD_FROM = _struct(
    from_id=_FWD_PEER, saved_from_peer=_FWD_PEER, channel_post=_str, saved_from_msg_id=_str, from_name=_str
)

# Numbers stay text because each use guards its own cast.
MEDIA_FIELDS = (
    "tl", "kind", "downloaded", "size_bytes", "document_id", "mime_type",
    "duration", "width", "height", "file_name", "phash", "path",
)
MEDIA = T.StructType([T.StructField(name, _str) for name in MEDIA_FIELDS])

HANDLE = _struct(username=_str, active=_bool, editable=_bool)
RESTRICTION = _struct(platform=_str, reason=_str, text=_str)

# Profile columns of a peer, in the order the merge uses them.
PROFILE_TYPES: dict[str, T.DataType] = {
    "title": _str, "first_name": _str, "last_name": _str, "username": _str,
    "usernames": T.ArrayType(HANDLE), "telegram_date": _ts, "verified": _bool, "scam": _bool, "fake": _bool,
    "restricted": _bool, "restriction_reason": T.ArrayType(RESTRICTION), "noforwards": _bool, "forum": _bool,
    "gigagroup": _bool, "join_to_send": _bool, "join_request": _bool, "has_link": _bool, "has_geo": _bool,
    "deleted": _bool, "premium": _bool, "deactivated": _bool, "slowmode_enabled": _bool,
    "linked_monoforum_id": _long, "migrated_to_channel_id": _long, "participants_count": _int, "about": _str,
    "linked_chat_id": _long, "migrated_from_chat_id": _long, "slowmode_seconds": _int, "hidden_prehistory": _bool,
    "available_min_id": _int, "participants_hidden": _bool, "admins_count": _int, "kicked_count": _int,
    "banned_count": _int, "online_count": _int, "ttl_period": _int, "pinned_msg_id": _int,
    "location_address": _str, "location_lat": _dbl, "location_lng": _dbl, "common_chats_count": _int,
}
PROFILE_COLUMNS = tuple(PROFILE_TYPES)

PEERS = T.StructType(
    [T.StructField("external_id", _long), T.StructField("peer_type", _str), T.StructField("access_hash", _long)]
    + [T.StructField(name, kind) for name, kind in PROFILE_TYPES.items()]
    + list(
        _struct(
            messages_scraped=_int, is_scraping=_bool, scrape_detail=_str, photo_media_kind=_str,
            last_message_id=_int, last_message_at=_ts,
            created_at=_ts, updated_at=_ts, first_message_id=_int, first_message_at=_ts,
            scope_r=_dbl, scope_j=_int, scope_score=_dbl,
            forward_r=_dbl, forward_j=_int, forward_n_events=_int, forward_score=_dbl,
        ).fields
    )
)

MESSAGES = _struct(
    id=_long, peer_external_id=_long, telegram_message_id=_long, date=_ts, content=_str, from_external_id=_long,
    fwd_from=FWD_FROM, media=MEDIA, text_embedded=_bool, image_embedded=_bool,
)

# What counting and graphs need of the text, stored beside it so that they never read the text itself.
STORED_MESSAGES = T.StructType([*MESSAGES.fields, *_struct(has_text=_bool, excerpt=_str).fields])

# A text that many messages share, stored once in ``message_texts``: its id there, and what counting, graphs and streams need
# of it. A message that has one carries no ``content`` of its own.
TEXT_REF = _struct(id=_long, has_text=_bool, has_excerpt=_bool, has_words=_bool)
# Its excerpt is cut from the text where it is shown; ``excerpt`` beside it is for texts of a message's own.
SLIM_MESSAGES = T.StructType([*STORED_MESSAGES.fields, *_struct(text_ref=TEXT_REF).fields])

# The counters of a peer.
COUNT_COLUMNS = (
    "posts", "text_total", "text_embedded", "image_total", "image_hashed", "image_downloaded", "image_unique",
    "image_persisted", "image_embeddable", "image_embedded_unique", "video_total", "video_downloaded",
    "audio_total", "audio_downloaded", "gif_total", "gif_downloaded", "document_total", "document_downloaded",
    "unique_forwards", "total_forwards",
)

MEDIA_KINDS = ("image", "video", "audio", "gif", "document")
PEER_TYPES = ("channel", "megagroup", "chat", "user", "bot")

TABLES: dict[str, T.StructType] = {
    "peers": PEERS,
    "messages": STORED_MESSAGES,
    "slim_messages": SLIM_MESSAGES,
    "message_texts": _struct(text_id=_long, content=_str),
    "peer_fetch_coverage": _struct(peer_external_id=_long, covered_after=_ts, covered_before=_ts),
    "peer_media_coverage": _struct(
        peer_external_id=_long, covered_after=_ts, covered_before=_ts,
        videos_excluded=_bool, large_excluded=_bool, max_media_bytes=_long,
    ),
    "forward_edges": _struct(
        from_external_id=_long, to_external_id=_long, from_peer_type=_str, to_peer_type=_str,
        last_from_name=_str, forward_count=_long, first_seen_at=_ts, last_seen_at=_ts,
    ),
    "forward_edge_messages": _struct(
        from_external_id=_long, to_external_id=_long, message_id=_long, message_date=_ts,
        telegram_message_id=_long, from_name=_str,
    ),
    "image_blobs": _struct(phash=_str, canonical_path=_str, refcount=_long, image_embedded=_bool, updated_at=_ts),
    "image_blob_messages": _struct(
        phash=_str, message_id=_long, message_date=_ts, peer_external_id=_long, telegram_message_id=_long
    ),
    "image_cache": _struct(phash=_str, cache_path=_str),
    "message_text_embeddings": _struct(message_id=_long, model_id=_str, dim=_int, embedding=_vector),
    "image_embeddings": _struct(phash=_str, model_id=_str, dim=_int, embedding=_vector),
    "scope_inputs": _struct(
        id=_long, kind=_str, body=_str, embedding=_vector, model_id=_str, created_at=_ts
    ),
    "image_scope_scores": _struct(phash=_str, s=_dbl, r=_dbl, version=_int),
    "peer_scope_evidence": _struct(peer_external_id=_long, pile=_str, phash=_str),
    "peer_scope_forward_events": _struct(message_id=_long, phash=_str, origin_peer_id=_long),
    "graph_nodes": _struct(
        id=_str, kind=_str, external_id=_long, peer_type=_str, label=_str, username=_str, scraped=_bool,
        is_scraping=_bool, degree=_long, forward_volume=_long, forwards_unique=_long, forwards_total=_long,
        media_kind=_str, date=_ts, telegram_message_id=_long, stub=_bool, message_id=_long, phash=_str,
    ),
    "graph_edges": _struct(source=_str, target=_str, kind=_str, count=_long),
    "peer_counts": T.StructType(
        [T.StructField("peer_external_id", _long)] + [T.StructField(name, _long) for name in COUNT_COLUMNS]
    ),
}
