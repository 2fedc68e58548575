"""Listings: catalog statistics, pages, orders, message rows and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.ids import is_target
from channelgraph.functions.media import media_kind, media_preview
from channelgraph.functions.predicates import date_window
from channelgraph.functions.text import peer_label, strip_to_null
from channelgraph.operators.forwards import with_origin
from channelgraph.operators.texts import with_few_texts, with_texts
from channelgraph.schemas import MEDIA_KINDS
from channelgraph.session import settle

# ---- peers

def attach_stats(peers: DataFrame, counts: DataFrame, fetch: DataFrame, media: DataFrame) -> DataFrame:
    """Peers with posts, forwards, media and embedding progress, each shown only where it means something."""
    fetched = fetch.select(F.col("peer_external_id").alias("external_id"), F.lit(True).alias("_fetch"))
    passes = media.select(
        F.col("peer_external_id").alias("external_id"), F.lit(True).alias("_media"),
        F.col("videos_excluded").alias("_videos"), F.col("large_excluded").alias("_large"),
        F.col("max_media_bytes").alias("_bytes"),
    )
    stored = counts.select(
        F.col("peer_external_id").alias("external_id"),
        F.struct(*[c for c in counts.columns if c != "peer_external_id"]).alias("_n"),
    )
    rows = (
        peers.join(stored, "external_id", "left").join(fetched, "external_id", "left")
        .join(passes, "external_id", "left")
    )

    def n(name: str) -> Column:
        return F.coalesce(F.col(f"_n.{name}"), F.lit(0))

    has_fetch, has_media = F.col("_fetch").isNotNull(), F.col("_media").isNotNull()
    kept = F.when(n("image_persisted") > 0, n("image_persisted")).otherwise(n("image_downloaded"))
    buckets = {}
    for kind in MEDIA_KINDS:
        total, done = n(f"{kind}_total"), n(f"{kind}_downloaded")
        if kind == "image":
            shown = has_media | (total > 0) | (kept > 0) | (n("image_hashed") > 0) | (n("image_unique") > 0)
            bucket = F.struct(
                total.alias("total"), n("image_hashed").alias("hashed"), kept.alias("downloaded"),
                n("image_unique").alias("unique"),
            )
        else:
            shown = has_media | (total > 0) | (done > 0)
            bucket = F.struct(total.alias("total"), done.alias("downloaded"))
        buckets[kind] = F.when(shown, bucket)

    posts = F.when(n("posts") > 0, n("posts")).otherwise(F.coalesce("messages_scraped", F.lit(0)).cast("bigint"))
    scraped = has_fetch | (posts > 0)
    forwards = has_fetch | (n("unique_forwards") > 0) | (n("total_forwards") > 0)

    def progress(done: Column, total: Column) -> Column:
        return F.when(scraped & (total > 0), F.struct(done.alias("done"), total.alias("total")))

    return rows.select(
        *peers.columns,
        has_fetch.alias("has_fetch_coverage"),
        (has_media | (n("image_unique") > 0)).alias("has_media_coverage"),
        F.when(scraped, posts).alias("posts"),
        F.when(forwards, n("unique_forwards")).alias("forwards_unique"),
        F.when(forwards, n("total_forwards")).alias("forwards_total"),
        F.struct(*[buckets[k].alias(k) for k in MEDIA_KINDS]).alias("media"),
        F.coalesce("_videos", F.lit(False)).alias("videos_excluded"),
        F.coalesce("_large", F.lit(False)).alias("large_excluded"),
        F.nullif(F.col("_bytes"), F.lit(0)).alias("max_media_bytes"),
        progress(n("text_embedded"), n("text_total")).alias("embed_text"),
        progress(n("image_embedded_unique"), n("image_embeddable")).alias("embed_images"),
    )


PUBLIC_PEER = (
    "external_id", "peer_type", "title", "username", "about", "participants_count", "photo_media_kind",
    "is_scraping", "scrape_detail", "messages_scraped", "last_message_id", "last_message_at", "created_at",
    "updated_at",
)


def public_peer(peers: DataFrame) -> DataFrame:
    return peers.select(
        *PUBLIC_PEER,
        F.bround(F.coalesce("scope_score", F.lit(0.0)), 4).alias("scope_score"),
        F.bround(F.coalesce("forward_score", F.lit(0.0)), 4).alias("forward_score"),
    )


def list_peers(peers: DataFrame, counts: DataFrame, fetch: DataFrame, media: DataFrame) -> DataFrame:
    """Every peer with its statistics, newest first."""
    return attach_stats(public_peer(peers), counts, fetch, media).orderBy(
        F.desc("created_at"), F.desc("external_id")
    )


def media_total(media: str = "media") -> Column:
    total = F.lit(0)
    for kind in MEDIA_KINDS:
        total = total + F.coalesce(F.col(f"{media}.{kind}.total"), F.lit(0))
    return total


def peer_order(key: str = "posts", direction: str = "desc") -> list[Column]:
    """Order of the peer table: running ones first, missing values last either way, ids last of all."""

    def by(c: Column) -> Column:
        return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()

    keys = {
        "peer": [
            F.lower(F.coalesce(peer_label(F.col("title"), F.col("username")), F.col("external_id").cast("string")))
        ],
        "added": [F.coalesce("created_at", "updated_at")],
        "subscribers": [F.col("participants_count")],
        "posts": [F.col("posts"), F.col("forwards_total"), media_total()],
    }[key]
    return [F.col("is_scraping").desc(), *[by(c) for c in keys], F.col("external_id").desc()]


def resolve_peer(peers: DataFrame, query: str) -> DataFrame:
    """The peer a text names: its id, else its handle, else one of its other handles. At most one row."""
    wanted = query.strip()
    try:
        number = int(wanted)
    except ValueError:
        number = None
    if number is not None and number != 0 and not wanted.startswith("@"):
        return peers.filter(F.col("external_id") == number).select("external_id", "username").limit(1)
    handle = wanted.removeprefix("@").lower()
    main = F.lower("username") == handle
    alias = F.exists("usernames", lambda h: F.lower(h["username"]) == handle)
    rank = F.when(main, 0).when(alias, 1)
    return (
        peers.select("external_id", "username", rank.alias("rank"))
        .filter(F.col("rank").isNotNull())
        .orderBy("rank", "external_id")
        .limit(1)
        .drop("rank")
    )


# ---- pages

def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, with_total: bool = False) -> DataFrame:
    """One page in a total order. Spark keeps only offset + limit rows per task.

    ``with_total`` adds how many rows there are in all.
    """
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", df.agg(F.count("*")).scalar()) if with_total else rows


def page_after(df: DataFrame, order: list[str], last: tuple, limit: int) -> DataFrame:
    """The next page of a listing that falls in all columns of ``order``, found by the last row seen instead of by counting off rows."""
    older, equal = F.lit(False), F.lit(True)
    for name, value in zip(order, last, strict=True):
        seen = F.lit(value).cast(df.schema[name].dataType)
        older, equal = older | (equal & (F.col(name) < seen)), equal & (F.col(name) == seen)
    return df.filter(older).orderBy(*[F.desc(c) for c in order]).limit(limit)


def newest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows and a flag that says whether there were more. The input is read once."""
    probe = settle(df.orderBy(*order).limit(n + 1), "newest")
    return probe.orderBy(*order).limit(n).withColumn("truncated", probe.agg(F.count("*") > n).scalar())


# ---- messages

def with_peer(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Messages with the peer that posted them; a message whose peer is unknown is not listed."""
    side = peers.select(
        F.col("external_id").alias("peer_external_id"), "peer_type", F.col("title").alias("peer_title"),
        F.col("username").alias("peer_username"), F.col("usernames").alias("peer_usernames"),
    )
    return messages.join(side, "peer_external_id")


def list_messages(
    messages: DataFrame, peers: DataFrame, peer: int | None = None, content_chars: int | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Rows of the message listing: text (cut for display only where ``content_chars`` says so), flags, media kind, peer.

    ``texts`` (text_id, content) resolves references, after all other joins.
    """
    if peer is not None:
        messages = messages.filter(F.col("peer_external_id") == peer)
    shown = messages.select(
        "id", "telegram_message_id", "date", *_carried(messages, content_chars, texts),
        "from_external_id", F.col("fwd_from").isNotNull().alias("forwarded"),
        media_kind(F.col("media")).alias("media_kind"), "peer_external_id",
    )
    listed = with_peer(shown, peers)
    return listed if texts is None else _cut(with_texts(listed, texts), content_chars)


def _carried(messages: DataFrame, content_chars: int | None, texts: DataFrame | None) -> list[Column | str]:
    """The text on its way to a listing: a long one of its own is cut before it moves, a shared one goes as its reference."""
    own = F.col("content") if content_chars is None else F.left("content", F.lit(content_chars)).alias("content")
    return [own] if texts is None else [own, "text_ref"]


def _cut(rows: DataFrame, content_chars: int | None) -> DataFrame:
    return rows if content_chars is None else rows.withColumn("content", F.left("content", F.lit(content_chars)))


def message_order() -> list[Column]:
    """Newest first; two peers can share a date and a number, so the id decides last."""
    return [F.desc("date"), F.desc("telegram_message_id"), F.desc("id")]


def message_page(
    messages: DataFrame, peers: DataFrame, limit: int, offset: int = 0, peer: int | None = None, content_chars: int | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """One page of the message listing, with the number of messages there are in all.

    The page is chosen among ids and dates. Its dates then bound the second scan, the only one that reads texts.
    ``texts`` (text_id, content) resolves references of the page.
    """
    chosen = messages if peer is None else messages.filter(F.col("peer_external_id") == peer)
    known = peers.select(F.col("external_id").alias("peer_external_id"))
    keys = chosen.select("id", "peer_external_id", "date", "telegram_message_id").join(known, "peer_external_id", "left_semi")
    picked = settle(page(keys, message_order(), limit, offset).select("id", "date"), "page")
    first, last = picked.agg(F.min("date"), F.max("date")).first()
    near = chosen.filter(date_window(F.col("date"), first, last)).join(picked.select("id"), "id", "left_semi")
    total = chosen.agg(F.count("*")).scalar()
    if texts is not None:
        near = with_few_texts(settle(near, "page-rows"), texts)
    return list_messages(near, peers, content_chars=content_chars).withColumn("total", total).orderBy(*message_order())


def first_phash(links: DataFrame) -> DataFrame:
    """The smallest hash linked to each message."""
    return links.groupBy("message_id").agg(F.min("phash").alias("link_phash"))


def message_detail(messages: DataFrame, links: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Whole text and media preview; the hash comes from the media record or else from the links.

    ``texts`` (text_id, content) resolves references, after the other join.
    """
    media = F.col("media")
    rows = messages.select(
        "id", "telegram_message_id", "date", *_carried(messages, None, texts), media_kind(media).alias("media_kind"), "media",
    )
    linked = first_phash(links).withColumnRenamed("message_id", "id")
    phash = F.when(
        F.col("media_kind") == "image", F.coalesce(strip_to_null(media["phash"]), strip_to_null(F.col("link_phash")))
    )
    found = rows.join(linked, "id", "left")
    found = found if texts is None else with_texts(found, texts)
    return found.select(
        "id", "telegram_message_id", "date", F.when(strip_to_null(F.col("content")).isNotNull(), F.col("content")).alias("content"),
        "media_kind", media_preview(media, phash, F.col("media_kind")).alias("media"),
    )


def lookup_origin(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """For every (origin_peer, origin_mid): the stored original, or else its newest forwarded copy."""
    key = ["origin_peer", "origin_mid"]
    wanted = keys.select(*key).distinct()
    slim = messages.select("id", "peer_external_id", "telegram_message_id", "date", "fwd_from")
    originals = slim.select(
        F.col("peer_external_id").alias("origin_peer"), F.col("telegram_message_id").alias("origin_mid"),
        F.col("id").alias("original_id"),
    )
    copies = (
        with_origin(slim.filter(F.col("fwd_from").isNotNull()))
        .groupBy(*key)
        .agg(F.max_by("id", F.struct("date", "id")).alias("copy_id"))
    )
    return (
        wanted.join(originals, key, "left")
        .join(copies, key, "left")
        .select(*key, F.coalesce("original_id", "copy_id").alias("id"), F.col("original_id").isNotNull().alias("stored"))
        .filter(F.col("id").isNotNull())
    )


def stored_originals(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Messages that are themselves the originals named by ``keys``."""
    wanted = keys.select(
        F.col("origin_peer").alias("peer_external_id"), F.col("origin_mid").alias("telegram_message_id")
    )
    return messages.join(wanted, ["peer_external_id", "telegram_message_id"], "left_semi")


def community_ids(edges: DataFrame) -> DataFrame:
    """Distinct ends of all edges."""
    ends = edges.select(F.col("from_external_id").alias("id")).unionByName(
        edges.select(F.col("to_external_id").alias("id"))
    )
    return ends.filter(is_target(F.col("id"))).distinct()
