"""Media kind, sizes, identities and previews over the typed media struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from channelgraph.functions.text import strip, strip_to_null
from channelgraph.schemas import MEDIA_KINDS

# File extensions per kind.
EXTENSIONS = {
    "gif": "gif",
    "image": "jpe?g|png|webp|bmp|tiff?|heic|heif|avif|jfif",
    "video": "mp4|m4v|mov|mkv|webm|avi|3gp|mpeg|mpg",
    "audio": "mp3|m4a|ogg|oga|flac|wav|opus|aac",
}
# Byte units.
UNITS = ("B", "KB", "MB", "GB", "TB")

TRUSTED_KINDS = ("image", "gif", "video", "audio")


def _kind_of_extension(file_name: Column) -> Column:
    # \z and not $, which in Java also matches before a final newline.
    rule = None
    for kind, pattern in EXTENSIONS.items():
        hit = file_name.rlike(rf"(?i)\.({pattern})\z")
        rule = F.when(hit, kind) if rule is None else rule.when(hit, kind)
    return rule


def _raster(mime: Column, *excluded: str) -> Column:
    hit = mime.startswith("image/")
    for word in excluded:
        hit = hit & ~F.contains(mime, F.lit(word))
    return hit


def media_kind(media: Column) -> Column:
    """Kind of a stored media record: trusted kind, MIME type, file name, document, then transport type."""
    kind, mime = media["kind"], F.lower(media["mime_type"])
    return F.coalesce(
        F.when(kind.isin(*TRUSTED_KINDS), kind),
        F.when(mime == "image/gif", "gif")
        .when(_raster(mime, "svg", "dwg"), "image")
        .when(mime.startswith("video/"), "video")
        .when(mime.startswith("audio/"), "audio"),
        _kind_of_extension(media["file_name"]),
        F.when(kind == "document", "document"),
        F.when(media["tl"] == "MessageMediaPhoto", "image").when(media["tl"] == "MessageMediaDocument", "document"),
    )


def base_name(file_name: Column) -> Column:
    return strip(F.element_at(F.split(F.translate(file_name, "\\", "/"), "/"), -1))


def kind_from_hints(mime_type: Column, file_name: Column, attributes: Column) -> Column:
    """Kind of a document from its attributes, MIME type and file name.

    ``attributes`` is an array of structs with a ``type`` field.
    """
    mime = F.lower(F.coalesce(strip_to_null(mime_type), F.lit("")))

    def has(kind: str) -> Column:
        return F.coalesce(F.exists(attributes, lambda a: a["type"] == kind), F.lit(False))

    return (
        F.when(has("sticker"), F.when(_raster(mime, "svg"), "image"))
        .when(has("animated") | (mime == "image/gif"), "gif")
        .when(has("audio") | mime.startswith("audio/"), "audio")
        .when(has("video") | mime.startswith("video/"), "video")
        .when(has("image_size") | _raster(mime, "svg", "dwg"), "image")
        .otherwise(F.coalesce(_kind_of_extension(base_name(file_name)), F.lit("document")))
    )


def media_kind_by_hints(media: Column) -> Column:
    """The second mode: untrusted kinds are inferred as for an incoming document."""
    present = (
        (F.coalesce(media["mime_type"], F.lit("")) != "")
        | (F.coalesce(media["file_name"], F.lit("")) != "")
        | F.coalesce(media["kind"] == "document", F.lit(False))
        | F.coalesce(media["tl"] == "MessageMediaDocument", F.lit(False))
    )
    none = F.array().cast("array<struct<type:string>>")
    return (
        F.when(media["kind"].isin(*TRUSTED_KINDS), media["kind"])
        .when(present, kind_from_hints(media["mime_type"], media["file_name"], none))
        .when(media["tl"] == "MessageMediaPhoto", "image")
    )


def has_phash(media: Column) -> Column:
    return F.coalesce(F.trim(media["phash"]) != "", F.lit(False))


def is_downloaded(media: Column) -> Column:
    return F.coalesce(media["downloaded"].isin("true", "t", "1"), F.lit(False))


def is_persisted(media: Column) -> Column:
    return is_downloaded(media) & F.coalesce(media["path"] != "", F.lit(False))


def digits_or_null(c: Column, kind: str = "bigint") -> Column:
    """A number only where the whole text is digits (or, for doubles, digits with one point)."""
    pattern = r"^[0-9]+(\.[0-9]+)?\z" if kind == "double" else r"^[0-9]+\z"
    return F.when(c.rlike(pattern), c.try_cast(kind))


def media_item_id(media: Column, message_id: Column) -> Column:
    own = F.concat(F.lit("msg:"), message_id.cast("string"))
    return F.coalesce(F.nullif(media["document_id"], F.lit("")), own)


def parse_item_id(c: Column) -> Column:
    """Split an item id into what it names and the name; null for anything else.

    Document ids are digits; message ids are UUIDs or, in archives with numeric keys, digits after ``msg:``.
    """
    raw = strip(c)
    own = F.lower(raw).startswith("msg:")
    ident = F.when(own, F.substring(raw, 5, 2**31 - 1)).otherwise(raw)
    uuid = F.lower(ident).rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
    digits = ident.rlike(r"^[0-9]+\z")
    return F.when(
        uuid | digits,
        F.struct(
            F.when(uuid | own, "message").otherwise("document").alias("kind"),
            F.lower(ident).alias("ident"),
        ),
    )


def format_bytes(size: Column) -> Column:
    """Human size on a base of 1024: no decimals from ten up, one below, none that is zero."""
    value = size.cast("double")
    label = None
    for power, unit in enumerate(UNITS):
        scaled = value / float(1024**power)
        if unit == "B":
            text = F.concat(F.format_string("%d", F.rint(scaled).cast("bigint")), F.lit(" B"))
        else:
            # rint and bround give halves to the even neighbour
            small = F.regexp_replace(F.format_string("%.1f", F.bround(scaled, 1)), r"\.0\z", "")
            large = F.format_string("%d", F.rint(scaled).cast("bigint"))
            text = F.concat(F.when(scaled >= 10, large).otherwise(small), F.lit(f" {unit}"))
        if unit == UNITS[-1]:
            label = label.otherwise(text)
        else:
            fits = scaled < 1024
            label = F.when(fits, text) if label is None else label.when(fits, text)
    return F.when((value >= 0) & ~F.isnan(value), label)


def media_preview(media: Column, phash: Column, kind: Column | None = None) -> Column:
    resolved = media_kind(media) if kind is None else kind
    size = F.floor(media["size_bytes"].try_cast("double")).cast("bigint")
    return F.when(
        resolved.isin(*MEDIA_KINDS),
        F.struct(
            resolved.alias("kind"),
            F.coalesce(strip_to_null(phash), strip_to_null(media["phash"])).alias("phash"),
            size.alias("size_bytes"),
            format_bytes(size).alias("size_label"),
            strip_to_null(media["mime_type"]).alias("mime_type"),
            strip_to_null(media["file_name"]).alias("file_name"),
            media["duration"].try_cast("double").alias("duration"),
            media["width"].try_cast("double").cast("bigint").alias("width"),
            media["height"].try_cast("double").cast("bigint").alias("height"),
        ),
    )
