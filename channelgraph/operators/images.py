"""Image links, the image registry and what can be read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.media import has_phash, media_kind
from channelgraph.functions.predicates import link_scope, local_path
from channelgraph.functions.text import is_dedupable, norm_phash
from channelgraph.operators.ranking import ranked_within

SNAPSHOT_FLAGS = ("image_unique", "image_persisted", "image_embeddable", "image_embedded_unique")


def image_links(messages: DataFrame, unique_ids: bool = False) -> DataFrame:
    """One row per message and image hash; hashes that identify nothing are left out."""
    phash = F.col("media.phash")
    links = messages.filter(
        is_dedupable(phash)
        & F.col("id").isNotNull()
        & F.col("date").isNotNull()
        & F.col("peer_external_id").isNotNull()
    ).select(
        norm_phash(phash).alias("phash"),
        F.col("id").alias("message_id"),
        F.col("date").alias("message_date"),
        "peer_external_id",
        "telegram_message_id",
    )
    return links if unique_ids else links.dropDuplicates(["phash", "message_id"])


def merge_links(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """New date and peer win; a message number only fills one that is missing."""
    key = ["phash", "message_id"]
    old, new = stored.alias("o"), fresh.alias("n")
    return old.join(new, key, "full_outer").select(
        *key,
        F.coalesce("n.message_date", "o.message_date").alias("message_date"),
        F.coalesce("n.peer_external_id", "o.peer_external_id").alias("peer_external_id"),
        F.coalesce("n.telegram_message_id", "o.telegram_message_id").alias("telegram_message_id"),
    )


def image_blobs(links: DataFrame, harvests: DataFrame) -> DataFrame:
    """One row per hash: the first stored path wins, the reference count is the number of links.

    ``harvests`` holds (phash, canonical_path, seen_at), any number of rows per hash.
    """
    path = F.col("canonical_path")
    first = (
        harvests.filter(is_dedupable(F.col("phash")))
        .groupBy(norm_phash(F.col("phash")).alias("phash"))
        .agg(
            F.min_by(path, F.when(path.isNotNull(), F.struct("seen_at", path))).alias("canonical_path"),
        )
    )
    counted = links.groupBy("phash").agg(F.count("*").alias("refcount"))
    return first.join(counted, "phash", "left").select(
        "phash", "canonical_path", F.coalesce("refcount", F.lit(0)).alias("refcount")
    )


def blob_flags(blobs: DataFrame, cache: DataFrame, trim_paths: bool = True) -> DataFrame:
    """Per hash: stored, embedded, and able to be embedded.

    The full recount takes a path of blanks for stored (``trim_paths=False``), the snapshot does not.
    """
    cached = cache.select("phash", F.lit(True).alias("cached")).dropDuplicates(["phash"])
    stored = F.coalesce(F.trim("canonical_path") != "", F.lit(False))
    loose = F.coalesce(F.col("canonical_path") != "", F.lit(False))
    embedded = F.coalesce("image_embedded", F.lit(False))
    return blobs.join(cached, "phash", "left").select(
        "phash",
        (stored if trim_paths else loose).alias("persisted"),
        embedded.alias("embedded"),
        (embedded | stored | F.col("cached").isNotNull()).alias("embeddable"),
    )


def phash_snapshot(links: DataFrame, blobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Per hash and peer: 1/0 for known, stored, embeddable, embedded."""
    pairs = links.filter(F.col("peer_external_id").isNotNull()).select("phash", "peer_external_id").distinct()
    return pairs.join(blob_flags(blobs, cache), "phash").select(
        "phash",
        "peer_external_id",
        F.lit(1).cast("bigint").alias("image_unique"),
        F.col("persisted").cast("bigint").alias("image_persisted"),
        F.col("embeddable").cast("bigint").alias("image_embeddable"),
        F.col("embedded").cast("bigint").alias("image_embedded_unique"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of the four counters per peer between two snapshots; peers without change are left out."""
    signed = after.unionByName(
        before.select("phash", "peer_external_id", *[(-F.col(c)).alias(c) for c in SNAPSHOT_FLAGS])
    )
    sums = signed.groupBy("peer_external_id").agg(*[F.sum(c).alias(c) for c in SNAPSHOT_FLAGS])
    changed = F.lit(False)
    for c in SNAPSHOT_FLAGS:
        changed = changed | (F.col(c) != 0)
    return sums.filter(changed)


def images_of_peer(links: DataFrame, peer: int) -> DataFrame:
    return links.filter(F.col("peer_external_id") == peer).select("phash").distinct()


def image_rollup(blobs: DataFrame, links: DataFrame, peer: int | None = None) -> DataFrame:
    """Appearances, peers and last date per image. With ``peer``, only images that also appear there.

    Links are first brought down to one row per hash and peer, so a viral image is never one task's work.
    """
    if peer is not None:
        blobs = blobs.join(images_of_peer(links, peer), "phash", "left_semi")
        links = links.join(blobs.select("phash"), "phash", "left_semi")
    per_peer = links.groupBy("phash", "peer_external_id").agg(
        F.count("*").alias("n"), F.max("message_date").alias("last")
    )
    per_image = per_peer.groupBy("phash").agg(
        F.sum("n").alias("appearances"),
        F.count("peer_external_id").alias("unique_peers"),
        F.max("last").alias("last_seen_at"),
    )
    return blobs.join(per_image, "phash", "left").select(
        "phash",
        "canonical_path",
        "refcount",
        F.coalesce("appearances", F.lit(0)).alias("appearances"),
        F.coalesce("unique_peers", F.lit(0)).alias("unique_peers"),
        "last_seen_at",
    )


def image_order(kind: str = "peers") -> list:
    """Order of image listings: shared ones first, or newest first."""
    peers, seen = F.col("unique_peers"), F.col("appearances")
    last = F.desc_nulls_last("last_seen_at")
    if kind == "date":
        return [last, peers.desc(), seen.desc(), F.col("phash").asc()]
    return [(peers > 1).desc(), (peers < seen).desc(), peers.desc(), seen.desc(), last, F.col("phash").asc()]


def image_peers(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Per image and peer: appearances, how many of them forwarded, last date."""
    flags = messages.select(F.col("id").alias("message_id"), F.col("fwd_from").isNotNull().alias("forwarded"))
    return (
        links.join(flags, "message_id")
        .groupBy("phash", "peer_external_id")
        .agg(
            F.count("*").alias("appearances"),
            F.count(F.when(F.col("forwarded"), 1)).alias("forwarded"),
            F.max("message_date").alias("last_seen_at"),
        )
    )


def hit_peers(hits: DataFrame, links: DataFrame, messages: DataFrame, peers: DataFrame) -> DataFrame:
    """The peers of each image that was found, most appearances first, then the newest, then the smaller id.

    ``hits`` holds (query_id, phash); only links of hits are counted.
    """
    fan = image_peers(links.join(hits.select("phash").distinct(), "phash", "left_semi"), messages)
    known = peers.select(F.col("external_id").alias("peer_external_id"), "peer_type", F.col("title").alias("peer_title"))
    # the order of an image's peers does not depend on who asked, and a viral image has very many of them
    order = [F.desc("appearances"), F.desc("last_seen_at"), F.asc("peer_external_id")]
    ranked = ranked_within(fan.join(known, "peer_external_id"), ["phash"], order, "place")
    return hits.select("query_id", "phash").join(ranked, "phash")


def shared_images(links: DataFrame, peer: int | None = None, start=None, end=None, min_peers: int = 2) -> DataFrame:
    """Images that appear in at least two peers inside the dates, with counts and first date."""
    per_peer = image_appearances(links, start, end)
    shared = (
        per_peer.groupBy("phash")
        .agg(
            F.count("*").alias("unique_peers"),
            F.sum("appearances").alias("appearances"),
            F.min("first_seen").alias("first_seen"),
            F.max(F.col("peer_external_id") == (peer if peer is not None else 0)).alias("has_peer"),
        )
        .filter(F.col("unique_peers") >= min_peers)
    )
    if peer is not None:
        shared = shared.filter("has_peer")
    return shared.drop("has_peer")


def image_appearances(links: DataFrame, start=None, end=None) -> DataFrame:
    return (
        links.filter(link_scope(start, end))
        .groupBy("phash", "peer_external_id")
        .agg(F.count("*").alias("appearances"), F.min("message_date").alias("first_seen"))
    )


def missing_phash(messages: DataFrame) -> DataFrame:
    """Image messages that have no hash yet."""
    media = F.col("media")
    return messages.filter(
        F.col("telegram_message_id").isNotNull() & (media_kind(media) == "image") & ~has_phash(media)
    )


def unpersisted(links: DataFrame, blobs: DataFrame) -> DataFrame:
    """Hashes per peer whose file was never stored."""
    lacking = blobs.filter(F.coalesce(F.col("canonical_path") == "", F.lit(True))).select("phash")
    return links.join(lacking, "phash", "left_semi").select("peer_external_id", "phash").distinct()


def has_pixels(blobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Images whose bytes are at hand: stored under a path of our own, or cached."""
    cached = cache.select("phash", F.lit(True).alias("cached")).dropDuplicates(["phash"])
    return (
        blobs.join(cached, "phash", "left")
        .filter(local_path(F.col("canonical_path")) | F.col("cached").isNotNull())
        .drop("cached")
    )
