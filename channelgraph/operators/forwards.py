"""Forward occurrences and the edges they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.forwards import fwd_name, fwd_origin, fwd_origin_msg
from channelgraph.functions.ids import infer_type, is_target

OCCURRENCE_KEY = ["from_external_id", "to_external_id", "message_id"]


def forward_occurrences(
    messages: DataFrame, stored: DataFrame | None = None, unique_ids: bool = False
) -> DataFrame:
    """One row per forwarded message: poster, origin, message.

    Forwards of one's own posts and from users are no edges. With ``stored``, only rows that are not there yet.
    ``unique_ids`` says that the input holds each message once, which saves a shuffle.
    """
    fwd = F.col("fwd_from")
    occ = messages.filter(is_occurrence()).select(
        F.col("peer_external_id").alias("from_external_id"),
        fwd_origin(fwd).alias("to_external_id"),
        F.col("id").alias("message_id"),
        F.col("date").alias("message_date"),
        "telegram_message_id",
        fwd_name(fwd).alias("from_name"),
    )
    if not unique_ids:
        occ = occ.dropDuplicates(OCCURRENCE_KEY)
    if stored is not None:
        occ = occ.join(stored.select(*OCCURRENCE_KEY), OCCURRENCE_KEY, "left_anti")
    return occ


def is_occurrence() -> Column:
    """Whether a message row is a forward that counts: between two different communities."""
    source, origin = F.col("peer_external_id"), fwd_origin(F.col("fwd_from"))
    known = F.col("fwd_from").isNotNull() & F.col("date").isNotNull() & F.col("id").isNotNull()
    return known & is_target(source) & is_target(origin) & (source != origin)


def forward_edges(occ: DataFrame, keep_named: bool = False) -> DataFrame:
    """One row per poster and origin, with its count, time span and newest name.

    ``keep_named`` adds ``named_by``, the date and id of the message that gave the name; merging needs it.
    """
    named = F.col("from_name").isNotNull()
    latest = F.struct("message_date", "message_id")
    return (
        occ.groupBy("from_external_id", "to_external_id")
        .agg(
            F.count("*").alias("forward_count"),
            F.min("message_date").alias("first_seen_at"),
            F.max("message_date").alias("last_seen_at"),
            F.max_by("from_name", F.when(named, latest)).alias("last_from_name"),
            F.max(F.when(named, latest)).alias("named_by"),
        )
        .select(
            "from_external_id",
            "to_external_id",
            infer_type(F.col("from_external_id")).alias("from_peer_type"),
            infer_type(F.col("to_external_id")).alias("to_peer_type"),
            "last_from_name",
            "forward_count",
            "first_seen_at",
            "last_seen_at",
            *(["named_by"] if keep_named else []),
        )
    )


def merge_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add edges of new occurrences to stored ones: counts add up, spans widen, the newest name stays.

    Both sides come from ``forward_edges(..., keep_named=True)``, and so does the result.
    """
    named = F.col("last_from_name").isNotNull()
    return stored.unionByName(fresh).groupBy("from_external_id", "to_external_id").agg(
        F.max("from_peer_type").alias("from_peer_type"),
        F.max("to_peer_type").alias("to_peer_type"),
        F.max_by("last_from_name", F.when(named, F.col("named_by"))).alias("last_from_name"),
        F.sum("forward_count").alias("forward_count"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.max("named_by").alias("named_by"),
    )


def recount_edges(edges: DataFrame, occ: DataFrame) -> DataFrame:
    """Set counts from the occurrences; an edge without any keeps the count it has."""
    key = ["from_external_id", "to_external_id"]
    counted = occ.groupBy(*key).agg(F.count("*").alias("n"))
    return edges.join(counted, key, "left").withColumn(
        "forward_count", F.coalesce("n", "forward_count")
    ).drop("n")


def unlinked_forwards(messages: DataFrame, occ: DataFrame) -> DataFrame:
    """Forwarded messages that have no occurrence row yet."""
    forwarded = messages.filter(F.col("fwd_from").isNotNull())
    return forwarded.join(occ.select(F.col("message_id").alias("id")), "id", "left_anti")


def with_origin(messages: DataFrame) -> DataFrame:
    fwd = F.col("fwd_from")
    return messages.withColumns({"origin_peer": fwd_origin(fwd), "origin_mid": fwd_origin_msg(fwd)})


def origin_keys(messages: DataFrame) -> DataFrame:
    """Distinct (peer, message id) pairs that the forwards name as originals."""
    return (
        with_origin(messages.filter(F.col("fwd_from").isNotNull()))
        .filter(F.col("origin_peer").isNotNull() & F.col("origin_mid").isNotNull())
        .select("origin_peer", "origin_mid")
        .distinct()
    )


def edge_titles(edges: DataFrame, peers: DataFrame) -> DataFrame:
    """Edges with title and handle of both ends; ends that are not in the catalog stay, without them."""

    def side(name: str) -> DataFrame:
        return peers.select(
            F.col("external_id").alias(f"{name}_external_id"),
            F.col("title").alias(f"{name}_title"),
            F.col("username").alias(f"{name}_username"),
        )

    return edges.join(side("from"), "from_external_id", "left").join(side("to"), "to_external_id", "left")


def latest_sample(messages: DataFrame) -> DataFrame:
    """For every poster and origin the newest message that forwards from it, either header counting."""
    fwd = F.col("fwd_from")

    def exact(peer: Column) -> Column:
        tag = F.coalesce(peer["_"], peer["tl"])

        def raw(name: str) -> Column:
            return F.when(peer[name].rlike(r"^[0-9]+\z"), peer[name].try_cast("bigint"))

        return (
            F.when(tag == "PeerChannel", -(F.lit(10**12) + raw("channel_id")))
            .when(tag == "PeerChat", -raw("chat_id"))
        )

    sides = F.array_distinct(F.array(exact(fwd["from_id"]), exact(fwd["saved_from_peer"])))
    return (
        messages.filter(fwd.isNotNull())
        .select(
            F.col("peer_external_id").alias("via"), F.explode(sides).alias("target"), "date", "telegram_message_id"
        )
        .filter(F.col("target").isNotNull())
        .groupBy("via", "target")
        .agg(F.max(F.struct("date", "telegram_message_id")).alias("latest"))
        .select("via", "target", F.col("latest.telegram_message_id").alias("telegram_message_id"))
    )
