"""Counters and forward edges as streaming aggregates whose keyed state the engine keeps.

Repeated deliveries are dropped by key and the rest is aggregated, both in the state store of the query, which is part of
its checkpoint. There is no watermark, since a scrape walks backwards in time: the state holds every key ever seen, on
disk (RocksDB), and a batch costs what its own rows cost. In update mode each batch gives the new totals of the groups it
touched; the sink keeps the newest total of each group. Which of several deliveries of a message in one batch counts is left
open, as the engine does: use :class:`channelgraph.streaming.jobs.CounterStream` where they differ and their order
matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.operators.counts import insert_facts, sum_facts
from channelgraph.operators.forwards import OCCURRENCE_KEY, forward_edges, forward_occurrences
from channelgraph.operators.merge import MESSAGE_KEY
from channelgraph.streaming.log import BatchLog

#: State on disk; a batch uploads its changes, not a snapshot.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class KeyedTotals:
    """Runs a stateful query and keeps the newest row of each group.

    A batch that runs again overwrites its own rows; groups are told apart by ``key``.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key
        self.log: BatchLog | None = None

    def run(self, totals: DataFrame, checkpoint: str) -> None:
        """Work through everything that is there now and stop; a later run goes on from the checkpoint."""
        self._open(totals.schema)
        had = {name: self.spark.conf.get(name, None) for name in STATE_SETTINGS}
        for name, value in STATE_SETTINGS.items():
            self.spark.conf.set(name, value)
        try:
            writer = totals.writeStream.outputMode("update").foreachBatch(self._keep).option("checkpointLocation", checkpoint)
            writer.trigger(availableNow=True).start().awaitTermination()
        finally:
            for name, value in had.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)

    def _open(self, schema: T.StructType) -> None:
        self.log = BatchLog(self.spark, self.path, schema)

    def _keep(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(batch, batch_id)

    def totals(self) -> DataFrame:
        return self._newest(self.log.all())

    def compact(self) -> None:
        """Older batches come down to one row a group."""
        self.log.compact(lambda rows: self._newest(rows))

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self.log.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*values), "batch_id").alias("row")).select(*self.key, *[F.col(f"row.{c}") for c in values])


def counter_totals(deliveries: DataFrame) -> DataFrame:
    """Per peer the counters of messages delivered for the first time. ``deliveries`` is a stream."""
    facts = insert_facts(deliveries, "telegram_message_id")
    return sum_facts(facts.dropDuplicates(MESSAGE_KEY))


def edge_totals(deliveries: DataFrame) -> DataFrame:
    """Per poster and origin the forward edge, each occurrence once. ``deliveries`` is a stream."""
    occurrences = forward_occurrences(deliveries, unique_ids=True).dropDuplicates(OCCURRENCE_KEY)
    return forward_edges(occurrences)


def counter_store(spark: SparkSession, path: str) -> KeyedTotals:
    return KeyedTotals(spark, path, ["peer_external_id"])


def edge_store(spark: SparkSession, path: str) -> KeyedTotals:
    return KeyedTotals(spark, path, ["from_external_id", "to_external_id"])
