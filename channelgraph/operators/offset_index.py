"""Pages of the message listing by offset, without sorting what comes before them.

Beside messages stored by month stands the number of messages of each peer and minute. Summed from the newest on, by day and
then by minute of a day, these numbers tell in which minutes a page lies; only the months of those minutes are opened, only
the messages of those minutes are put in order, and any number of pages is answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelgraph.functions.timecov import micros
from channelgraph.operators.listing import message_order
from channelgraph.operators.side_tables import SideTable
from channelgraph.session import settle

#: Minute of messages without a date, which are listed last; a whole number of days.
NO_DATE = -(10**9) * 1440
DAY = 1440


def minute_of(date: Column) -> Column:
    return F.coalesce(F.floor(micros(date) / 60_000_000).cast("long"), F.lit(NO_DATE))


class OffsetIndex(SideTable):
    """Messages by peer and minute of those stored by month at ``messages``, kept at ``root``."""

    schema = "minute long, peer_external_id long, n long, month string"
    order = ("minute", "peer_external_id")

    def rows(self, messages: DataFrame) -> DataFrame:
        return messages.groupBy("month", minute_of(F.col("date")).alias("minute"), "peer_external_id").agg(F.count("*").alias("n"))

    def _listed(self, rows: DataFrame, peers: DataFrame | None) -> DataFrame:
        """Rows of known peers; all where no peers are given."""
        if peers is None:
            return rows
        return rows.join(peers.select(F.col("external_id").alias("peer_external_id")).distinct(), "peer_external_id", "left_semi")

    def _slices(self, asked: DataFrame, peers: DataFrame | None) -> DataFrame:
        """page, scope, start, end, minute, month, before: the minutes that each page touches, and how many messages are newer."""
        counts = self._listed(self.table(), peers)
        scopes = asked.select("scope").filter(F.col("scope").isNotNull()).distinct()
        of_peer = counts.withColumn("scope", F.col("peer_external_id")).join(scopes, "scope", "left_semi")
        of_all = counts.withColumn("scope", F.lit(None).cast("long"))
        minutes = of_all.unionByName(of_peer).groupBy("scope", "minute", "month").agg(F.sum("n").alias("n"))
        minutes = minutes.withColumn("day", F.floor(F.col("minute") / DAY).cast("long"))
        newer_days = Window.partitionBy("scope").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
        days = minutes.groupBy("scope", "day").agg(F.sum("n").alias("in_day"))
        days = days.withColumn("before_day", F.coalesce(F.sum("in_day").over(newer_days), F.lit(0)))
        a, d, m = asked.alias("a"), days.alias("d"), minutes.alias("m")
        touched = (F.col("d.before_day") < F.col("a.end")) & (F.col("d.before_day") + F.col("d.in_day") > F.col("a.start"))
        on_days = a.join(d, F.col("a.scope").eqNullSafe(F.col("d.scope")) & touched).select("a.*", "d.day", "d.before_day")
        needed = on_days.select("scope", "day", "before_day").distinct().alias("k")
        same_day = F.col("m.scope").eqNullSafe(F.col("k.scope")) & (F.col("m.day") == F.col("k.day"))
        newer = Window.partitionBy("scope", "day").orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
        placed = m.join(needed, same_day).select("m.*", "k.before_day")
        placed = placed.withColumn("before", F.col("before_day") + F.coalesce(F.sum("n").over(newer), F.lit(0))).alias("p")
        o = on_days.alias("o")
        within = (F.col("p.before") < F.col("o.end")) & (F.col("p.before") + F.col("p.n") > F.col("o.start"))
        at = F.col("o.scope").eqNullSafe(F.col("p.scope")) & (F.col("o.day") == F.col("p.day")) & within
        return o.join(placed, at).select("o.page", "o.scope", "o.start", "o.end", "p.minute", "p.month", "p.before")

    def pages(self, requests: DataFrame, peers: DataFrame | None = None) -> DataFrame:
        """page, place (from 0 in the whole listing), id, peer_external_id, telegram_message_id, date.

        ``requests`` have page (an id of their own), peer (null: all peers), offset and limit. The order is that of
        ``message_order``. With ``peers`` only messages of peers that are in it are listed.
        """
        start = F.greatest(F.col("offset").cast("long"), F.lit(0))
        asked = requests.select("page", F.col("peer").cast("long").alias("scope"), start.alias("start"), (start + F.col("limit")).alias("end"))
        slices = settle(self._slices(asked, peers), "page-slices")
        months = [r["month"] for r in slices.select("month").distinct().collect()]  # one string per month of history
        narrow = self.stored().filter(F.col("month").isin(months))
        narrow = narrow.select("id", "peer_external_id", "telegram_message_id", "date", minute_of(F.col("date")).alias("minute"))
        narrow = self._listed(narrow, peers)
        wanted = slices.select("scope", "minute", "before").distinct()
        for_all = narrow.join(wanted.filter("scope IS NULL"), "minute")
        keyed = wanted.filter("scope IS NOT NULL").withColumn("peer_external_id", F.col("scope"))
        of_peers = narrow.join(keyed, ["peer_external_id", "minute"])
        within = Window.partitionBy("scope", "minute").orderBy(*message_order())
        ranked = for_all.unionByName(of_peers).withColumn("place", F.col("before") + F.row_number().over(within) - 1)
        r, s = ranked.alias("r"), slices.alias("s")
        here = (F.col("r.place") >= F.col("s.start")) & (F.col("r.place") < F.col("s.end"))
        on = F.col("r.scope").eqNullSafe(F.col("s.scope")) & (F.col("r.minute") == F.col("s.minute")) & here
        return s.join(r, on).select("s.page", "r.place", *[f"r.{c}" for c in ("id", "peer_external_id", "telegram_message_id", "date")])
