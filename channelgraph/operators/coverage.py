"""What part of a peer's history and media has been collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.timecov import bound, layer_fill
from channelgraph.operators.counts import with_kind
from channelgraph.operators.listing import attach_stats
from channelgraph.schemas import MEDIA_KINDS
from channelgraph.session import settle

LAYERS = (*MEDIA_KINDS, "text_embed", "image_embed")
#: Messages of a peer that meet its floor in one task; a channel with more meets it in several parts.
FLOOR_ROWS = 1_000_000


def media_windows(messages: DataFrame, links: DataFrame) -> DataFrame:
    """First and last date per peer and layer, in one pass over the messages.

    Images count once hashed, other media once downloaded. Where no hashed image message is left, the dates of the
    image links stand in.
    """
    facts = with_kind(messages, "peer_external_id", "date", "text_embedded", "image_embedded")
    kind, done = F.col("kind"), F.col("downloaded")
    tests: dict[str, Column] = {name: (kind == name) & done for name in MEDIA_KINDS}
    tests["image"] = (kind == "image") & F.col("hashed")
    tests["text_embed"] = F.col("text") & F.col("text_embedded")
    tests["image_embed"] = (kind == "image") & F.col("image_embedded")
    aggs = []
    for name in LAYERS:
        dated = F.when(tests[name], F.col("date"))
        aggs += [F.min(dated).alias(f"{name}_after"), F.max(dated).alias(f"{name}_before")]
    windows = facts.groupBy("peer_external_id").agg(*aggs)
    linked = links.groupBy("peer_external_id").agg(
        F.min("message_date").alias("link_after"), F.max("message_date").alias("link_before")
    )
    lacking = F.col("image_after").isNull()
    return (
        windows.join(linked, "peer_external_id", "left")
        .withColumns(
            {
                "image_before": F.when(lacking, F.col("link_before")).otherwise(F.col("image_before")),
                "image_after": F.coalesce("image_after", "link_after"),
            }
        )
        .drop("link_after", "link_before")
    )


def fetch_coverage(messages: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """Date window per peer. ``floor`` (peer_external_id, min_id) keeps a lone early message out of it.

    Floors are repeated for busy peers only, once for each part, so all repetitions together are at most one for each
    ``FLOOR_ROWS`` messages.
    """
    rows = messages.select("peer_external_id", "telegram_message_id", "date")
    if floor is not None:
        counted = rows.groupBy("peer_external_id").agg(F.count("*").alias("n")).filter(F.col("n") > FLOOR_ROWS)
        busy = counted.select("peer_external_id", F.ceil(F.col("n") / FLOOR_ROWS).cast("int").alias("parts"))
        busy = settle(busy.filter(F.col("peer_external_id").isNotNull()), "busy-peers")
        number = F.coalesce(F.pmod(F.xxhash64("telegram_message_id"), "parts").cast("int"), F.lit(0))
        rows = rows.join(F.broadcast(busy), "peer_external_id", "left").withColumn("part", number).drop("parts")
        last = F.coalesce("parts", F.lit(1)) - 1
        floors = floor.select("peer_external_id", "min_id").join(F.broadcast(busy), "peer_external_id", "left")
        floors = floors.select("peer_external_id", "min_id", F.explode(F.sequence(F.lit(0), last)).alias("part"))
        rows = (
            rows.join(floors, ["peer_external_id", "part"], "left")
            .filter(F.col("min_id").isNull() | (F.col("telegram_message_id") >= F.col("min_id")))
            .groupBy("peer_external_id", "part")
            .agg(F.min("date").alias("first"), F.max("date").alias("date"))
        )
    else:
        rows = rows.withColumn("first", F.col("date"))
    return (
        rows.groupBy("peer_external_id")
        .agg(F.min("first").alias("covered_after"), F.max("date").alias("covered_before"))
        .filter(F.col("covered_before").isNotNull())
    )


def media_coverage(messages: DataFrame, policy: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Window and exclusions after a media pass over the peers in ``policy``.

    A pass without a size limit keeps the limit stored before.
    """
    covered = fetch_coverage(messages).join(policy, "peer_external_id")
    if stored is None:
        return covered
    flags = ["covered_after", "covered_before", "videos_excluded", "large_excluded"]
    old, new = stored.alias("o"), covered.withColumn("fresh", F.lit(True)).alias("n")
    fresh = F.col("fresh").isNotNull()
    return old.join(new, "peer_external_id", "full_outer").select(
        "peer_external_id",
        *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in flags],
        F.coalesce("n.max_media_bytes", "o.max_media_bytes").alias("max_media_bytes"),
    )


def id_span(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Lowest and highest message number per peer, the first-message probe aside."""
    probe = peers.filter(F.col("first_message_id").isNotNull()).select(
        F.col("external_id").alias("peer_external_id"), F.col("first_message_id").alias("telegram_message_id")
    )
    # joined on both columns, which spreads a busy peer
    return (
        messages.select("peer_external_id", "telegram_message_id")
        .join(probe, ["peer_external_id", "telegram_message_id"], "left_anti")
        .groupBy("peer_external_id")
        .agg(F.min("telegram_message_id").alias("lo"), F.max("telegram_message_id").alias("hi"))
    )


def first_message_dates(peers: DataFrame, messages: DataFrame) -> DataFrame:
    """Peers with the first message's date filled from the stored message where it was missing."""
    wanted = peers.filter(F.col("first_message_at").isNull() & F.col("first_message_id").isNotNull()).select(
        F.col("external_id").alias("peer_external_id"), F.col("first_message_id").alias("telegram_message_id")
    )
    found = (
        messages.select("peer_external_id", "telegram_message_id", "date")
        .join(wanted, ["peer_external_id", "telegram_message_id"], "left_semi")
        .select(F.col("peer_external_id").alias("external_id"), F.col("date").alias("stored_at"))
    )
    return (
        peers.join(found, "external_id", "left")
        .withColumn("first_message_at", F.coalesce("first_message_at", "stored_at"))
        .drop("stored_at")
    )


def peer_coverage(
    peers: DataFrame,
    messages: DataFrame,
    links: DataFrame,
    counts: DataFrame,
    fetch: DataFrame,
    media: DataFrame,
    now,
) -> DataFrame:
    """The coverage report of every peer: timeline, posts, media layers, forwards and embeddings."""
    moment = bound(now)
    stats = attach_stats(first_message_dates(peers, messages), counts, fetch, media)
    spans = fetch.select(
        F.col("peer_external_id").alias("external_id"),
        F.col("covered_after").alias("posts_after"),
        F.col("covered_before").alias("posts_before"),
    )
    passes = media.select(
        F.col("peer_external_id").alias("external_id"),
        F.struct(
            "covered_after", "covered_before", "videos_excluded", "large_excluded", "max_media_bytes"
        ).alias("media_pass"),
    )
    windows = media_windows(messages, links).withColumnRenamed("peer_external_id", "external_id")
    totals = counts.select(
        F.col("peer_external_id").alias("external_id"), "text_total", "text_embedded", "image_embeddable",
        "image_embedded_unique",
    )
    rows = (
        stats.join(spans, "external_id", "left")
        .join(passes, "external_id", "left")
        .join(windows, "external_id", "left")
        .join(totals, "external_id", "left")
    )
    origin = F.col("first_message_at")

    def fill(after: str) -> Column:
        return layer_fill(origin, moment, F.col(after))

    def layer(name: str, *extra: Column) -> Column:
        return F.struct(
            *extra,
            F.col(f"{name}_after").alias("covered_after"),
            F.col(f"{name}_before").alias("covered_before"),
            fill(f"{name}_after").alias("fill"),
        )

    def number(name: str, alias: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(alias)

    posts_fill = fill("posts_after")
    forwarded = F.coalesce(F.col("forwards_total") > 0, F.lit(False))
    return rows.select(
        "external_id",
        F.struct(origin.alias("start"), moment.alias("end"), "first_message_id").alias("timeline"),
        F.struct(
            F.col("posts_after").alias("covered_after"),
            F.col("posts_before").alias("covered_before"),
            F.col("posts").alias("count"),
            posts_fill.alias("fill"),
        ).alias("posts"),
        "media_pass",
        F.struct(*[layer(name).alias(name) for name in MEDIA_KINDS]).alias("media_layers"),
        F.when(forwarded, posts_fill).otherwise(0.0).alias("forwards_fill"),
        F.struct(
            layer("text_embed", number("text_total", "total"), number("text_embedded", "done")).alias("text"),
            layer(
                "image_embed", number("image_embeddable", "total"), number("image_embedded_unique", "done")
            ).alias("images"),
        ).alias("embeds"),
    )
