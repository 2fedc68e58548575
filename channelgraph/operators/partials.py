"""Counts, date windows and image roll-ups kept as partial aggregates by month.

Messages stored by month (:func:`channelgraph.operators.merge.write_by_month`) have beside them two small tables in the same
folders: one row per month and peer, one per month, image and peer. When a delivery is written back, only the months that it
touched are aggregated again; every total is a merge of partials, so no message outside those months is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelgraph.operators.counts import message_counts
from channelgraph.operators.coverage import LAYERS, media_windows
from channelgraph.operators.images import image_links
from channelgraph.operators.merge import write_back
from channelgraph.session import drop_settled, settle

SUMS = tuple(["posts", "text_total", "text_embedded", "image_hashed"])
WINDOWS = tuple(f"{layer}_{end}" for layer in LAYERS for end in ("after", "before"))


def peer_partials(messages: DataFrame) -> DataFrame:
    """One row per peer: message counters, first and last date, and the window of each media layer by messages alone."""
    none = messages.select("peer_external_id", F.col("date").alias("message_date")).limit(0)
    spans = messages.groupBy("peer_external_id").agg(F.min("date").alias("covered_after"), F.max("date").alias("covered_before"))
    counted = message_counts(messages)
    return counted.join(spans, "peer_external_id").join(media_windows(messages, none), "peer_external_id", "left")


def image_partials(messages: DataFrame) -> DataFrame:
    """One row per image and peer: appearances and last date."""
    return image_links(messages, unique_ids=True).groupBy("phash", "peer_external_id").agg(
        F.count("*").alias("appearances"), F.max("message_date").alias("last_seen_at")
    )


class MonthlyPartials:
    """The partials of the messages stored by month at ``messages``, kept at ``root``."""

    def __init__(self, spark: SparkSession, messages: str, root: str):
        self.spark, self.messages, self.root = spark, messages, root

    def rebuild(self) -> None:
        """All months."""
        self._write([r["month"] for r in self._stored().select("month").distinct().collect()])

    def write_back(self, delta: DataFrame, order: str | None = None, strict_kind: bool = True) -> list[str]:
        """Merge a delivery into the messages and aggregate the months it touched again. Returns these months."""
        months = write_back(self.spark, self.messages, delta, order, strict_kind)
        names = sorted(r["month"] for r in months.collect())  # one string per month of history
        self._write(names)
        return names

    def _stored(self) -> DataFrame:
        # the names of months are text, not numbers
        return self.spark.read.parquet(self.messages)

    def _write(self, names: list[str]) -> None:
        """Folder by folder of months that are given; every other folder stays as it is."""
        rows = self._stored().filter(F.col("month").isin(names))
        for table, partials, keys in (("peers", peer_partials, ["peer_external_id"]), ("images", image_partials, ["phash", "peer_external_id"])):
            done = self._by_month(rows.filter("peer_external_id IS NOT NULL") if table == "images" else rows, partials, keys)
            laid = settle(done, f"partials-{table}")
            writer = laid.repartitionByRange("month", *keys).sortWithinPartitions("month", *keys).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.root}/{table}")
            drop_settled(laid)

    @staticmethod
    def _by_month(rows: DataFrame, partials, keys: list[str]) -> DataFrame:
        """The partials of all given months in one pass: the month goes along in the peer's place as a pair."""
        pair = F.struct("month", "peer_external_id").alias("peer_external_id")
        paired = rows.select(*[F.col(c) for c in rows.columns if c not in ("month", "peer_external_id")], pair)
        done = partials(paired)
        return done.select(F.col("peer_external_id.month").alias("month"), *[F.col("peer_external_id.peer_external_id").alias("peer_external_id") if k == "peer_external_id" else F.col(k) for k in keys], *[c for c in done.columns if c not in keys])

    def peers(self) -> DataFrame:
        """Per peer the message counters, first and last date, and media windows over all months."""
        rows = self.spark.read.parquet(f"{self.root}/peers")
        sums = [c for c in rows.columns if c in SUMS or c.endswith(("_total", "_downloaded"))]
        return rows.groupBy("peer_external_id").agg(
            *[F.sum(c).alias(c) for c in dict.fromkeys(sums)],
            F.min("covered_after").alias("covered_after"), F.max("covered_before").alias("covered_before"),
            *[(F.min if c.endswith("_after") else F.max)(c).alias(c) for c in WINDOWS],
        )

    def images(self) -> DataFrame:
        """Per image its appearances, peers and last date over all months."""
        rows = self.spark.read.parquet(f"{self.root}/images")
        per_peer = rows.groupBy("phash", "peer_external_id").agg(F.sum("appearances").alias("n"), F.max("last_seen_at").alias("last"))
        return per_peer.groupBy("phash").agg(
            F.sum("n").alias("appearances"), F.count("peer_external_id").alias("unique_peers"), F.max("last").alias("last_seen_at")
        )
