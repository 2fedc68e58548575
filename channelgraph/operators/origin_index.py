"""Who posted or forwarded from whom, found without reading every message.

"Posted by a peer or forwarded from it" is two questions. Messages stored by month
(:func:`channelgraph.operators.merge.write_by_month`) lie in order of their poster, so the first is a pruned scan of them.
For the second there is a table of postings beside them: one narrow row per message and origin that one of its headers
names, by month and in order of the origin. A delivery rewrites the postings of the months it touches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.forwards import header_origins
from channelgraph.functions.media import media_kind
from channelgraph.functions.predicates import date_window, media_in
from channelgraph.functions.timecov import bound
from channelgraph.operators.side_tables import SideTable
from channelgraph.session import settle

FOUND = ["id", "peer_external_id", "telegram_message_id", "date", "media_kind", "month"]


def postings(messages: DataFrame) -> DataFrame:
    """One row per message and origin that one of its headers names; ``messages`` carry their month."""
    return messages.filter(F.col("fwd_from").isNotNull()).select(
        F.explode(header_origins(F.col("fwd_from"))).alias("origin"),
        *[media_kind(F.col("media")).alias(c) if c == "media_kind" else F.col(c) for c in FOUND],
    )


def months_between(start=None, end=None) -> Column:
    """The months that a date window can touch; without a bound also messages without a date."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col("month") >= F.date_format(bound(start), "yyyy-MM"))
    if end is not None:
        test = test & (F.col("month") <= F.date_format(bound(end), "yyyy-MM"))
    return test


class OriginIndex(SideTable):
    """The postings of the messages stored by month at ``messages``, kept at ``root``."""

    schema = "origin long, id long, peer_external_id long, telegram_message_id long, date timestamp_ntz, media_kind string, month string"
    order = ("origin", "date", "id")

    def rows(self, messages: DataFrame) -> DataFrame:
        return postings(messages)

    def _own(self, window: Column) -> DataFrame:
        """Messages by their poster, in the columns of postings."""
        kind = media_kind(F.col("media")).alias("media_kind")
        return self.stored().filter(window).select(*[kind if c == "media_kind" else F.col(c) for c in FOUND])

    def scope(self, peer: int, start=None, end=None, media: Iterable[str] | None = None) -> DataFrame:
        """id, peer, number, date, kind and month of the messages posted by the peer or forwarded from it, each once."""
        window = date_window(F.col("date"), start, end) & months_between(start, end)
        own = self._own(window & (F.col("peer_external_id") == peer))
        named = self.table().filter((F.col("origin") == peer) & window & ~F.col("peer_external_id").eqNullSafe(peer))
        found = own.unionByName(named.drop("origin"))
        return found if media is None else found.filter(media_in(F.col("media_kind"), media))

    def scopes(self, peers: DataFrame, start=None, end=None, media: Iterable[str] | None = None) -> DataFrame:
        """The scope of each of many peers (external_id) in one pass: external_id and the columns of :meth:`scope`."""
        window = date_window(F.col("date"), start, end) & months_between(start, end)
        wanted = peers.select("external_id").filter("external_id IS NOT NULL").distinct()
        own = self._own(window).withColumn("external_id", F.col("peer_external_id"))
        named = self.table().filter(window & ~F.col("peer_external_id").eqNullSafe(F.col("origin")))
        found = own.unionByName(named.withColumnRenamed("origin", "external_id"))
        found = found if media is None else found.filter(media_in(F.col("media_kind"), media))
        return found.join(wanted, "external_id", "left_semi")

    def whole(self, found: DataFrame) -> DataFrame:
        """The stored messages of a scope; only the months that it names are opened.

        The keys are written first: only then Spark knows how few they are and leaves the stored messages where they lie.
        """
        keys = settle(found.select("month", "peer_external_id", "telegram_message_id").distinct(), "scope-keys")
        return self.stored().join(keys, ["month", "peer_external_id", "telegram_message_id"], "left_semi").drop("month")
