"""What of a graph is shown, and small questions about a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.predicates import MEDIA_KEYS
from channelgraph.operators.graph import EDGE_COLUMNS
from channelgraph.session import settle


@dataclass(frozen=True)
class Layers:
    """Which nodes and edges to show. The defaults are the peer forward graph."""

    scraped_peers: bool = True
    unscraped_peers: bool = True
    forward_messages: bool = False
    shared_images: bool = False
    self_forwards: bool = False
    forward_from: bool = True
    forward_to: bool = False
    sent_to: bool = True
    forwarded_from: bool = True
    appeared_in: bool = True
    media: frozenset[str] = field(default_factory=lambda: frozenset(MEDIA_KEYS))


PRESETS = {
    "peer-forwards": Layers(),
    "shared-images": Layers(
        shared_images=True, forward_from=False, sent_to=False, forwarded_from=False, appeared_in=True
    ),
}


def self_forwards(edges: DataFrame) -> DataFrame:
    """Messages that only peers they came from have forwarded.

    Both edge kinds of a message are brought down to one row per message and peer; a message qualifies if every
    forwarder is an origin and it has at least one of each.
    """
    origin, forwarder = F.col("kind") == "sent_to", F.col("kind") == "forwarded_from"
    pairs = (
        edges.filter(origin | forwarder)
        .select(
            F.when(origin, F.col("source")).otherwise(F.col("target")).alias("id"),
            F.when(origin, F.col("target")).otherwise(F.col("source")).alias("peer"),
            origin.alias("origin"), forwarder.alias("forwarder"),
        )
        .groupBy("id", "peer")
        .agg(F.max("origin").alias("origin"), F.max("forwarder").alias("forwarder"))
    )
    foreign = F.col("forwarder") & ~F.col("origin")
    return (
        pairs.groupBy("id")
        .agg(F.max("origin").alias("o"), F.max("forwarder").alias("f"), F.max(foreign).alias("foreign"))
        .filter(F.col("o") & F.col("f") & ~F.col("foreign"))
        .select("id")
    )


def expand_edges(edges: DataFrame, layers: Layers) -> DataFrame:
    """Edges of the chosen kinds; a forward can be drawn from either end or from both."""
    shown = [k for k in ("forward_from", "forward_to", "sent_to", "forwarded_from", "appeared_in") if getattr(layers, k)]
    plain = edges.select(*EDGE_COLUMNS).filter(F.col("kind").isin(*shown))
    if not layers.forward_to:
        return plain
    turned = edges.filter(F.col("kind") == "forward_from").select(
        F.col("target").alias("source"), F.col("source").alias("target"), F.lit("forward_to").alias("kind"), "count"
    )
    return plain.unionByName(turned)


def _both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(
        ids.select(F.col("id").alias("target")), "target", "left_semi"
    )


def filter_graph(nodes: DataFrame, edges: DataFrame, layers: Layers = Layers()) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that the layers show.

    A message needs both where it came from and who forwarded it, an image at least one peer; peers stand alone.
    ``nodes`` and ``edges`` are used several times each, so they should be stored tables. The visible edges are
    needed for both results and are written once.
    """
    kind = F.col("kind")
    live = F.col("scraped") | F.coalesce("is_scraping", F.lit(False))
    media = F.coalesce("media_kind", F.lit("none")).isin(*sorted(layers.media)) if layers.media else F.lit(False)
    visible = (
        F.when(kind == "image", F.lit(layers.shared_images))
        .when(kind == "message", F.lit(layers.forward_messages) & media)
        .when(live, F.lit(layers.scraped_peers))
        .otherwise(F.lit(layers.unscraped_peers))
    )
    shown = nodes.filter(visible)
    if not layers.self_forwards:
        shown = shown.join(self_forwards(edges), "id", "left_anti")
    lines = settle(_both_ends(expand_edges(edges, layers), shown), "visible-edges")
    marks = (
        lines.filter(F.col("kind").isin("sent_to", "forwarded_from", "appeared_in"))
        .select(
            F.when(F.col("kind") == "forwarded_from", F.col("target")).otherwise(F.col("source")).alias("id"),
            F.col("kind").alias("mark"),
        )
        .groupBy("id")
        .agg(*[F.max(F.col("mark") == k).alias(k) for k in ("sent_to", "forwarded_from", "appeared_in")])
    )
    kept = (
        shown.join(marks, "id", "left")
        .filter(
            F.when(kind == "image", F.coalesce("appeared_in", F.lit(False)))
            .when(kind == "message", F.coalesce(F.col("sent_to") & F.col("forwarded_from"), F.lit(False)))
            .otherwise(True)
        )
        .select(*nodes.columns)
    )
    return kept, _both_ends(lines, kept)


def merge_graph(
    peers: tuple[DataFrame, DataFrame], messages: tuple[DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Peer layer from the one graph, message layer from the other."""
    layer = F.col("kind").isin("sent_to", "forwarded_from")
    nodes = peers[0].filter("kind <> 'message'").unionByName(messages[0].filter("kind = 'message'"))
    return nodes, peers[1].filter(~layer).unionByName(messages[1].filter(layer))


def new_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes that an earlier snapshot did not have."""
    return new.join(old.select("id"), "id", "left_anti")


def graph_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and an order-free hash of what a viewer would notice. Equal graphs give equal rows."""

    def part(df: DataFrame, *columns: str):
        # 60 bits of a hash of the fields in turn; a decimal holds the sum of any number of them
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("h"))

    n = part(nodes, "id", "kind", "scraped", "is_scraping", "degree", "forward_volume", "media_kind")
    e = part(edges, "source", "kind", "target", "count")
    return nodes.sparkSession.range(1).select(
        n.select("n").scalar().alias("nodes"), e.select("n").scalar().alias("edges"),
        F.md5(F.concat_ws("|", n.select("h").scalar(), e.select("h").scalar())).alias("fingerprint"),
    )


def neighbours(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Peers around message or image nodes: ``kind`` is sent_to, forwarded_from or appeared_in."""
    node, peer = ("target", "source") if kind == "forwarded_from" else ("source", "target")
    wanted = "image" if kind == "appeared_in" else "message"
    pairs = edges.filter(F.col("kind") == kind).select(F.col(node).alias("id"), F.col(peer).alias("peer"))
    known = nodes.filter(F.col("kind") == "peer").select(F.col("id").alias("peer"), F.col("label").alias("peer_label"))
    return pairs.join(nodes.filter(F.col("kind") == wanted).select("id"), "id", "left_semi").join(known, "peer")
