"""Graphs of forwards between peers, of forwarded messages, and of images that peers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.media import media_kind
from channelgraph.functions.predicates import message_scope
from channelgraph.functions.text import has_excerpt, peer_label, stored_excerpt
from channelgraph.operators.forwards import is_occurrence, with_origin
from channelgraph.operators.images import image_appearances, shared_images
from channelgraph.operators.listing import newest
from channelgraph.operators.texts import with_excerpts
from channelgraph.schemas import MEDIA_KINDS, TABLES

# Limits and size estimates. They label what a screen can show; no graph is cut by them.
SCREEN_LIMIT = 40_000
AUTO_LIMITS = {"nodes": 25_000, "edges": 80_000, "bytes": 25 * 1024 * 1024}
CONFIRM_LIMITS = {"nodes": 80_000, "edges": 200_000, "bytes": 80 * 1024 * 1024}
BYTES_PER_PEER, BYTES_PER_MESSAGE, BYTES_PER_EDGE = 220, 420, 80
IMAGE_EDGE_FACTOR = 8

EDGE_COLUMNS = TABLES["graph_edges"].fieldNames()


def _nodes(df: DataFrame, **columns) -> DataFrame:
    """Fill up to the common node shape."""
    return df.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["graph_nodes"].fields]
    )


def _peer_nodes(metrics: DataFrame, peers: DataFrame, fetched: DataFrame) -> DataFrame:
    """Peer nodes from ids with their metrics, named and typed from the catalog where it knows them."""
    known = peers.select(
        F.col("external_id").alias("peer_id"), F.col("peer_type").alias("known_type"), "title", "username",
        "messages_scraped", "is_scraping",
    )
    covered = fetched.select(F.col("peer_external_id").alias("peer_id"), F.lit(True).alias("covered"))
    rows = metrics.join(known, "peer_id", "left").join(covered, "peer_id", "left")
    return _nodes(
        rows,
        id=F.col("peer_id").cast("string"),
        kind=F.lit("peer"),
        external_id=F.col("peer_id"),
        peer_type=F.coalesce("known_type", "edge_type", F.lit("channel")),
        label=peer_label(F.col("title"), F.col("username"), F.col("edge_name")),
        username=F.col("username"),
        scraped=F.col("covered").isNotNull() | (F.coalesce("messages_scraped", F.lit(0)) > 0),
        is_scraping=F.coalesce("is_scraping", F.lit(False)),
        degree=F.col("degree"),
        forward_volume=F.col("volume"),
        forwards_unique=F.col("unique_out"),
        forwards_total=F.col("total_out"),
    )


def node_order() -> list[Column]:
    return [F.desc("forward_volume"), F.desc("degree"), F.asc("external_id")]


def forward_graph(
    edges: DataFrame, peers: DataFrame, fetched: DataFrame, label_origins: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Who forwards from whom.

    Each edge counts at both of its ends. Neighbours that forward from each other count once, so ends are made
    distinct per neighbour before they are counted; that step also spreads a hub over many tasks. A node without
    title or handle is labelled with the name on its outgoing edges (with ``label_origins``, its incoming ones).
    """
    count = F.col("forward_count")
    src, dst = F.col("from_external_id"), F.col("to_external_id")

    def half(node: Column, nbr: Column, kind: str, out: bool) -> Column:
        name = F.when(F.lit(out != label_origins) & (F.trim("last_from_name") != ""), F.trim("last_from_name"))
        return F.struct(
            node.alias("peer_id"), nbr.alias("nbr"), count.alias("n"),
            F.lit(1 if out else 0).alias("out"), (count if out else F.lit(0).cast("bigint")).alias("out_n"),
            F.col(kind).alias("type"), name.alias("name"),
        )

    halves = edges.select(
        F.explode(F.array(half(src, dst, "from_peer_type", True), half(dst, src, "to_peer_type", False))).alias("h")
    ).select("h.*")
    per_neighbour = halves.groupBy("peer_id", "nbr").agg(
        F.sum("n").alias("n"), F.sum("out").alias("out"), F.sum("out_n").alias("out_n"),
        F.max("type").alias("type"), F.max("name").alias("name"),
    )
    metrics = per_neighbour.groupBy("peer_id").agg(
        F.count("*").alias("degree"), F.sum("n").alias("volume"), F.sum("out").alias("unique_out"),
        F.sum("out_n").alias("total_out"), F.max("type").alias("edge_type"),
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("nbr"))).alias("edge_name"),
    )
    lines = edges.select(
        src.cast("string").alias("source"), dst.cast("string").alias("target"), F.lit("forward_from").alias("kind"),
        count.alias("count"),
    )
    return _peer_nodes(metrics, peers, fetched), lines


# ---- messages

def scoped_forwards(messages: DataFrame, **scope) -> DataFrame:
    """Forwarded messages inside a scope, with what the message layer needs of them.

    Whether a message counts as a forward is read from its own header, by the rule that fills the occurrence table;
    joining that table instead would shuffle every message.
    """
    return messages.filter(message_scope(**scope) & is_occurrence()).select(
        "id", "peer_external_id", "telegram_message_id", "date", *_shown(messages.columns),
        has_excerpt(messages.columns).alias("has_excerpt"), "fwd_from", media_kind(F.col("media")).alias("media_kind"),
    )


def _shown(columns: list[str]) -> list[Column]:
    """The excerpt of a message's own text, and the shared text it refers to."""
    return [stored_excerpt(columns), *([F.col("text_ref.id").alias("text_id")] if "text_ref" in columns else [])]


def message_layer(forwards: DataFrame, messages: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One node per original message, with an edge to the peer it came from and one from each peer that forwarded it.

    A stored original is used as it is. Any other becomes a stub put together from its forwards, newest first: the
    earliest date, the first text and the first media kind found, and the number of the row that last added one of
    these. The rows are never collected: each of the three is the row that comes first in that order, which
    ``max_by`` finds with partial aggregation, and the one latest in the order is the lowest of the three.
    Of shared texts only the id goes through this; the excerpt is cut from ``texts`` for the nodes at the end.
    """
    if texts is None and ("text_id" in forwards.columns or "text_ref" in messages.columns):
        raise ValueError("messages refer to texts: give the texts too")
    if "text_id" not in forwards.columns:
        forwards = forwards.withColumn("text_id", F.lit(None).cast("long"))
    if "has_excerpt" not in forwards.columns:
        forwards = forwards.withColumn("has_excerpt", F.col("excerpt").isNotNull())
    key = ["origin_peer", "origin_mid"]
    fwd = with_origin(forwards).filter(F.col("origin_peer").isNotNull() & F.col("origin_mid").isNotNull())
    place = F.struct(F.col("date").alias("d"), (-F.col("id")).alias("i"))
    has_text, has_kind = F.col("has_excerpt"), F.col("media_kind").isin(*MEDIA_KINDS)
    stubs = fwd.groupBy(*key).agg(
        F.min("date").alias("stub_date"),
        F.max_by(F.struct("text_id", "excerpt"), F.when(has_text, place)).alias("stub_text"),
        F.max_by("media_kind", F.when(has_kind, place)).alias("stub_kind"),
        F.least(
            F.max(place), F.max(F.when(has_text, place)), F.max(F.when(has_kind, place))
        ).alias("place"),
    )
    originals = messages.select(
        F.col("peer_external_id").alias("origin_peer"), F.col("telegram_message_id").alias("origin_mid"),
        F.col("id").alias("stored_id"), "date", *_shown(messages.columns), media_kind(F.col("media")).alias("media_kind"),
    )
    if "text_id" not in originals.columns:
        originals = originals.withColumn("text_id", F.lit(None).cast("long"))
    rows = stubs.join(originals, key, "left")
    stored = F.col("stored_id").isNotNull()
    stub_id = F.concat_ws(":", F.lit("m:orig"), "origin_peer", "origin_mid")
    node_id = F.when(stored, F.concat(F.lit("m:"), F.col("stored_id").cast("string"))).otherwise(stub_id)
    rows = rows.withColumn("node_id", node_id)
    none = F.lit(0)
    labelled = rows.withColumn("label", F.when(stored, F.struct("text_id", "excerpt")).otherwise(F.col("stub_text")))
    labelled = labelled.drop("text_id", "excerpt", "stub_text")
    if texts is None:
        labelled = labelled.withColumn("label", F.col("label.excerpt"))
    else:
        labelled = with_excerpts(labelled, texts, "label", "node_id")
    nodes = _nodes(
        labelled,
        id=F.col("node_id"),
        kind=F.lit("message"),
        external_id=F.col("origin_peer"),
        peer_type=F.lit("message"),
        label=F.col("label"),
        scraped=stored,
        is_scraping=F.lit(False),
        degree=none,
        forward_volume=none,
        forwards_unique=none,
        forwards_total=none,
        media_kind=F.when(stored, F.col("media_kind")).otherwise(F.col("stub_kind")),
        date=F.when(stored, F.col("date")).otherwise(F.col("stub_date")),
        telegram_message_id=F.col("origin_mid"),
        stub=~stored,
        message_id=F.when(stored, F.col("stored_id")).otherwise(-F.col("place.i")),
    )
    names = rows.select(*key, "node_id")
    posted = names.select(
        F.col("node_id").alias("source"), F.col("origin_peer").cast("string").alias("target"),
        F.lit("sent_to").alias("kind"),
    )
    # distinct before the join, so that a post forwarded by everyone meets its name once per forwarder
    forwarded = (
        fwd.select("peer_external_id", *key)
        .distinct()
        .join(names, key)
        .select(
            F.col("peer_external_id").cast("string").alias("source"), F.col("node_id").alias("target"),
            F.lit("forwarded_from").alias("kind"),
        )
    )
    return nodes, posted.unionByName(forwarded).withColumn("count", F.lit(1).cast("bigint"))


def message_graph(messages: DataFrame, texts: DataFrame | None = None, **scope) -> tuple[DataFrame, DataFrame]:
    """The message layer of all forwards in scope."""
    return message_layer(scoped_forwards(messages, **scope), messages, texts)


def newest_message_graph(messages: DataFrame, n: int, texts: DataFrame | None = None, **scope) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The message layer of the newest ``n`` forwards in scope, and one row ``truncated``: whether there were more."""
    chosen = newest(scoped_forwards(messages, **scope), n, [F.desc_nulls_last("date"), F.asc("id")])
    return *message_layer(chosen.drop("truncated"), messages, texts), _truncated(chosen)


def _truncated(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"))


# ---- shared images

def shared_image_graph(
    links: DataFrame, peers: DataFrame, fetched: DataFrame, peer: int | None = None, start=None, end=None
) -> tuple[DataFrame, DataFrame]:
    """All images that two or more peers show, linked to those peers."""
    return _image_graph(shared_images(links, peer, start, end), links, peers, fetched, start, end)


def top_shared_image_graph(
    links: DataFrame, peers: DataFrame, fetched: DataFrame, n: int, peer: int | None = None, start=None, end=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``n`` most shared images with their peers, and one row ``truncated``: whether there were more."""
    shared = shared_images(links, peer, start, end)
    chosen = newest(shared, n, [F.desc("unique_peers"), F.desc("appearances"), F.asc("phash")])
    return *_image_graph(chosen.drop("truncated"), links, peers, fetched, start, end), _truncated(chosen)


def _image_graph(shared: DataFrame, links: DataFrame, peers: DataFrame, fetched: DataFrame, start, end):
    shown = image_appearances(links, start, end).join(shared.select("phash"), "phash", "left_semi")
    metrics = shown.groupBy(F.col("peer_external_id").alias("peer_id")).agg(
        F.count("*").alias("degree"), F.sum("appearances").alias("volume"), F.count("*").alias("unique_out"),
        F.sum("appearances").alias("total_out"), F.lit(None).cast("string").alias("edge_type"),
        F.lit(None).cast("string").alias("edge_name"),
    )
    label = F.concat(F.col("unique_peers").cast("string"), F.lit(" peers"))
    images = _nodes(
        shared,
        id=F.concat(F.lit("img:"), "phash"),
        kind=F.lit("image"),
        external_id=F.lit(0),
        peer_type=F.lit("image"),
        label=label,
        scraped=F.lit(True),
        is_scraping=F.lit(False),
        degree=F.col("unique_peers"),
        forward_volume=F.col("appearances"),
        forwards_unique=F.col("unique_peers"),
        forwards_total=F.col("appearances"),
        media_kind=F.lit("image"),
        date=F.col("first_seen"),
        phash=F.col("phash"),
    )
    lines = shown.select(
        F.concat(F.lit("img:"), "phash").alias("source"), F.col("peer_external_id").cast("string").alias("target"),
        F.lit("appeared_in").alias("kind"), F.col("appearances").alias("count"),
    )
    return _peer_nodes(metrics, peers, fetched).unionByName(images), lines


# ---- statistics and budget

def estimate_bytes(peers: Column, messages: Column, edges: Column) -> Column:
    return peers * BYTES_PER_PEER + messages * BYTES_PER_MESSAGE + edges * BYTES_PER_EDGE


def budget_band(nodes: Column, edges: Column, size: Column) -> Column:
    def beyond(limits: dict[str, int]) -> Column:
        return (nodes > limits["nodes"]) | (edges > limits["edges"]) | (size > limits["bytes"])

    return F.when(beyond(CONFIRM_LIMITS), "block").when(beyond(AUTO_LIMITS), "confirm").otherwise("auto")


def is_open(peer=None, start=None, end=None, **_) -> bool:
    return peer is None and start is None and end is None


def _band(open_scope: bool, peers: Column, items: Column, fixed_edges: Column, per_item: int) -> Column:
    """An open request is judged by its full size; a scoped one by what the limit lets through, never refused."""
    if open_scope:
        edges = fixed_edges + items * per_item
        return budget_band(peers + items, edges, estimate_bytes(peers, items, edges))
    capped = F.least(items, F.lit(SCREEN_LIMIT))
    edges = fixed_edges + capped * per_item
    band = budget_band(peers + capped, edges, estimate_bytes(peers, capped, edges))
    return F.when(band == "block", "confirm").otherwise(band)


def graph_stats(edges: DataFrame, occ: DataFrame, messages: DataFrame, **scope) -> DataFrame:
    """Size of the forward graph with its messages, and whether to load it at once, after asking, or not at all."""
    ends = edges.select(F.explode(F.array("from_external_id", "to_external_id")).alias("id")).distinct()
    if is_open(**scope) and scope.get("media") is None:
        scoped = occ.agg(F.count("*"))
    else:
        scoped = messages.filter(message_scope(**scope) & is_occurrence()).agg(F.count("*"))
    counted = edges.sparkSession.range(1).select(
        ends.agg(F.count("*")).scalar().alias("peer_count"),
        edges.agg(F.count("*")).scalar().alias("peer_edge_count"),
        occ.agg(F.count("*")).scalar().alias("message_forward_count"),
        scoped.scalar().alias("scoped_message_count"),
    )
    peers, lines, items = F.col("peer_count"), F.col("peer_edge_count"), F.col("scoped_message_count")
    all_edges = lines + items * 2
    return counted.select(
        "*",
        (peers + items).alias("estimated_nodes"),
        all_edges.alias("estimated_edges"),
        estimate_bytes(peers, items, all_edges).alias("bytes_estimate"),
        _band(is_open(**scope), peers, items, lines, 2).alias("band"),
        (F.lit(is_open(**scope)) & (items > SCREEN_LIMIT)).alias("messages_omitted"),
    )


def shared_image_stats(links: DataFrame, peer: int | None = None, start=None, end=None) -> DataFrame:
    """Size of the shared-image graph and its band."""
    shared = shared_images(links, peer, start, end)
    shown = image_appearances(links, start, end).join(shared.select("phash"), "phash", "left_semi")
    sums = shown.agg(
        F.count("*").alias("edge_count"), F.count_distinct("peer_external_id").alias("peer_count"),
        F.count_distinct("phash").alias("image_count"),
    )
    peers, images, lines = F.col("peer_count"), F.col("image_count"), F.col("edge_count")
    open_scope = is_open(peer, start, end)
    if open_scope:
        band = budget_band(peers + images, lines, estimate_bytes(peers, images, lines))
    else:
        kept = F.least(images, F.lit(SCREEN_LIMIT))
        edges = F.least(lines, F.lit(SCREEN_LIMIT * IMAGE_EDGE_FACTOR))
        band = budget_band(peers + kept, edges, estimate_bytes(peers, kept, edges))
        band = F.when(band == "block", "confirm").otherwise(band)
    return sums.select(
        peers.alias("peer_count"), images.alias("image_count"), lines.alias("edge_count"),
        (peers + images).alias("estimated_nodes"), lines.alias("estimated_edges"),
        estimate_bytes(peers, images, lines).alias("bytes_estimate"), band.alias("band"),
        (F.lit(open_scope) & (images > SCREEN_LIMIT)).alias("images_omitted"),
    )


def node_size(nodes: DataFrame, base: float = 8.0, volume_weight: float = 0.4) -> DataFrame:
    """Drawing size: peers by the logarithm of their volume against the largest, messages and images small."""
    base = base if base > 0 else 8.0
    spread = min(1.0, max(0.0, volume_weight) / 0.4)
    low, high = base * (1 - 0.7 * spread), base * (1 + 1.6 * spread)
    small = F.col("kind").isin("message", "image")
    volume = F.greatest(F.coalesce("forward_volume", F.lit(0)), F.lit(0))
    largest = nodes.filter(~small).agg(F.greatest(F.max(volume), F.lit(1))).scalar()
    share = F.log1p(volume.cast("double")) / F.log1p(F.coalesce(largest, F.lit(1)).cast("double"))
    size = (low + (high - low) * share) * F.when(F.col("is_scraping"), 1.2).otherwise(1.0)
    return nodes.withColumn("size", F.when(small, max(1.0, base * 0.28)).otherwise(size))
