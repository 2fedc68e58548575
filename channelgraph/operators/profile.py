"""Incoming entities and media, flattened to archive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.ids import nonzero_chat, positive_channel
from channelgraph.functions.media import kind_from_hints
from channelgraph.functions.text import clean_restrictions, strip_to_null, usernames
from channelgraph.schemas import PROFILE_TYPES

# Fields an entity and its full profile carry under the same name.
ENTITY_FLAGS = (
    "verified", "scam", "fake", "restricted", "noforwards", "forum", "gigagroup", "join_to_send", "join_request",
    "has_link", "has_geo", "deleted", "premium", "deactivated", "slowmode_enabled",
)
FULL_NUMBERS = (
    "slowmode_seconds", "available_min_id", "admins_count", "kicked_count", "banned_count", "online_count",
    "ttl_period", "pinned_msg_id", "common_chats_count",
)
FULL_FLAGS = ("hidden_prehistory", "participants_hidden")


def flatten_profile(raw: DataFrame) -> DataFrame:
    """Nested ``entity`` and ``full`` structs to the flat profile columns.

    Fields the input lacks become null, so partial entities need no padding.
    """
    shapes = {name: set(raw.schema[name].dataType.fieldNames()) for name in ("entity", "full")}

    def get(side: str, name: str) -> Column:
        return F.col(side)[name] if name in shapes[side] else F.lit(None)

    def entity(name: str) -> Column:
        return get("entity", name)

    def full(name: str) -> Column:
        return get("full", name)

    def text(c: Column) -> Column:
        return strip_to_null(c.cast("string"))

    first, last = text(entity("first_name")), text(entity("last_name"))
    name = F.nullif(F.concat_ws(" ", first, last), F.lit(""))
    linked = full("linked_chat_id")
    location = full("location")
    here = "location" in shapes["full"]
    listed = entity("usernames") if "usernames" in shapes["entity"] else F.lit(None)
    handles = usernames(entity("username").cast("string"), listed)
    out: dict[str, Column] = {
        "title": F.coalesce(text(entity("title")), name),
        "first_name": first,
        "last_name": last,
        "username": text(entity("username")),
        "usernames": F.when(F.size(handles) > 0, handles),
        "telegram_date": entity("date"),
        "restriction_reason": clean_restrictions(entity("restriction_reason"))
        if "restriction_reason" in shapes["entity"]
        else F.lit(None),
        "linked_monoforum_id": positive_channel(entity("linked_monoforum_id").cast("bigint")),
        "migrated_to_channel_id": positive_channel(entity("migrated_to_channel_id").cast("bigint")),
        "participants_count": F.coalesce(full("participants_count").cast("int"), entity("participants_count").cast("int")),
        "about": text(full("about")),
        # a chat linked to itself is no link
        "linked_chat_id": F.when(~linked.eqNullSafe(entity("id")), positive_channel(linked.cast("bigint"))),
        "migrated_from_chat_id": nonzero_chat(full("migrated_from_chat_id").cast("bigint")),
        "location_address": text(location["address"]) if here else F.lit(None),
        "location_lat": location["geo_point"]["lat"] if here else F.lit(None),
        "location_lng": location["geo_point"]["long"] if here else F.lit(None),
    }
    out |= {flag: entity(flag) for flag in ENTITY_FLAGS}
    out |= {field: full(field) for field in (*FULL_NUMBERS, *FULL_FLAGS)}
    keep = [c for c in raw.columns if c not in ("entity", "full")]
    return raw.select(*keep, *[out[c].cast(kind).alias(c) for c, kind in PROFILE_TYPES.items()])


def classify_media(raw: DataFrame) -> DataFrame:
    """Incoming media to the slim stored record.

    Input column ``raw``: struct of ``tl`` and ``document`` (id, size, mime_type, attributes with type, file_name,
    duration, w, h).
    """
    media, doc = F.col("raw"), F.col("raw.document")
    is_doc = (media["tl"] == "MessageMediaDocument") & doc.isNotNull()
    attrs = doc["attributes"]

    def last(test, field: str, positive: bool = True) -> Column:
        def usable(a: Column) -> Column:
            present = a[field].isNotNull()
            return test(a) & (present & (a[field] != 0) if positive else present)

        return F.try_element_at(F.filter(attrs, usable), F.lit(-1))[field].cast("string")

    def sized(a: Column) -> Column:
        return a["type"].isin("video", "image_size")

    name = F.try_element_at(
        F.filter(attrs, lambda a: (a["type"] == "filename") & (F.coalesce(a["file_name"], F.lit("")) != "")), F.lit(-1)
    )["file_name"]
    kind = F.when(media["tl"] == "MessageMediaPhoto", "image").when(
        is_doc, kind_from_hints(doc["mime_type"], name, attrs)
    )

    def of_doc(c: Column) -> Column:
        return F.when(is_doc, c)

    record = F.struct(
        media["tl"].alias("tl"),
        kind.alias("kind"),
        F.lit("false").alias("downloaded"),
        of_doc(doc["size"].cast("string")).alias("size_bytes"),
        of_doc(doc["id"].cast("string")).alias("document_id"),
        of_doc(F.nullif(doc["mime_type"], F.lit(""))).alias("mime_type"),
        of_doc(last(sized, "duration", positive=False)).alias("duration"),
        of_doc(last(sized, "w")).alias("width"),
        of_doc(last(sized, "h")).alias("height"),
        of_doc(name).alias("file_name"),
        F.lit(None).cast("string").alias("phash"),
        F.lit(None).cast("string").alias("path"),
    )
    return raw.withColumn("media", F.when(media.isNotNull(), record)).drop("raw")
