"""Media and forward headers kept whole, as VARIANT columns, and merged key by key.

The typed structs of a message hold the fields that the library reads. A header can carry more: keys nobody has named yet,
nested objects, and keys that are there with a JSON null. Whole headers keep all of that through any number of deliveries;
the structs can be read from them again at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.operators.merge import MESSAGE_KEY
from channelgraph.schemas import FWD_FROM, MEDIA

OBJECT = "map<string,variant>"


def whole(text: Column) -> Column:
    """A header as it arrives; text that is no JSON counts as absent."""
    return F.try_parse_json(text)


def keys_of(header: Column) -> Column:
    """The keys of a header with their values; null for what is absent or no object."""
    return F.try_variant_get(header, "$", OBJECT)


def typed(headers: DataFrame) -> DataFrame:
    """The structs that the rest of the library reads, from whole headers."""
    return headers.withColumns(
        {"fwd_from": F.from_json(F.to_json("fwd_from"), FWD_FROM), "media": F.from_json(F.to_json("media"), MEDIA)}
    )


def fold_headers(deliveries: DataFrame, order: str, strict_kind: bool = True) -> DataFrame:
    """Several deliveries of a message become the headers that applying them one after the other would leave.

    A key of the media keeps the value it had first, a JSON null included, except the kind, where the last one that has
    the key wins. The forward header is the last one there is. With ``strict_kind`` an update after which no side has a kind
    leaves no media at all (as in ``merge_messages``). A message that came once keeps its headers as they are.

    Every key is folded for itself by partial aggregates, so no task holds the deliveries of a message together.
    """
    rank = F.col(order)
    rows = deliveries.select(*MESSAGE_KEY, "fwd_from", "media", rank.alias("_rank"), keys_of(F.col("media")).alias("_keys"))
    at, has_kind = F.col("_rank"), F.coalesce(F.map_contains_key("_keys", "kind"), F.lit(False))
    said = F.col("fwd_from").isNotNull() & ~F.coalesce(F.is_variant_null("fwd_from"), F.lit(False))
    messages = rows.groupBy(*MESSAGE_KEY).agg(
        F.count("*").alias("_n"),
        F.min("_rank").alias("_first"),
        F.min(F.when(has_kind, at)).alias("_known"),
        F.max_by("fwd_from", F.when(said, at)).alias("fwd_from"),
        F.min_by("media", at).alias("_media"),
    )
    marked = rows.select(*MESSAGE_KEY, "_rank", "_keys").join(messages.select(*MESSAGE_KEY, "_n", "_first", "_known"), MESSAGE_KEY)
    marked = marked.filter(F.col("_n") > 1)
    waits = marked.groupBy(*MESSAGE_KEY).agg(F.count(F.when(at < F.col("_known"), 1)).alias("_before"))
    entries = marked.select(*MESSAGE_KEY, "_rank", "_first", "_known", F.explode("_keys").alias("_key", "_value"))
    values = entries.groupBy(*MESSAGE_KEY, "_key").agg(
        F.max_by("_value", at).alias("_last"),
        F.min_by("_value", at).alias("_any"),
        F.min_by("_value", F.when(at == F.col("_first"), at)).alias("_early"),
        F.min_by("_value", F.when(at >= F.col("_known"), at)).alias("_later"),
    )
    if strict_kind:
        # what came before the first known kind is left only where the kind came with the very next delivery
        kept = F.when(F.col("_before") == 1, F.coalesce("_early", "_later")).otherwise(F.col("_later"))
    else:
        kept = F.col("_any")
    value = F.when(F.col("_key") == "kind", F.col("_last")).otherwise(kept)
    objects = values.join(waits, MESSAGE_KEY).select(*MESSAGE_KEY, "_key", value.alias("_value")).filter(F.col("_value").isNotNull())
    pairs = F.map_from_entries(F.collect_list(F.struct("_key", "_value")))
    merged = objects.groupBy(*MESSAGE_KEY).agg(F.to_variant_object(pairs).alias("_merged"))
    media = F.when(F.col("_n") == 1, F.col("_media")).otherwise(F.col("_merged"))
    return messages.join(merged, MESSAGE_KEY, "left").select(*MESSAGE_KEY, "fwd_from", media.alias("media"))


def merge_headers(stored: DataFrame, delta: DataFrame, order: str, strict_kind: bool = True) -> DataFrame:
    """Stored whole headers with those of deliveries merged in; both have the message key, fwd_from and media as VARIANT.

    ``order`` is the column of ``delta`` that ranks the deliveries of a message. Headers of messages that were not
    delivered again are passed through.
    """
    columns = [*MESSAGE_KEY, "fwd_from", "media"]
    keys = delta.select(*MESSAGE_KEY).distinct()
    unset = F.lit(None).cast(delta.schema[order].dataType)
    held = stored.join(keys, MESSAGE_KEY, "left_semi").select(*columns, F.struct(F.lit(0).alias("delivered"), unset.alias("at")).alias("_rank"))
    sent = delta.select(*columns, F.struct(F.lit(1).alias("delivered"), F.col(order).alias("at")).alias("_rank"))
    untouched = stored.join(keys, MESSAGE_KEY, "left_anti").select(*columns)
    return untouched.unionByName(fold_headers(held.unionByName(sent), "_rank", strict_kind).select(*columns))
