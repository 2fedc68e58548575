"""Live archive maintenance: messages, counters, forwards, coverage and relevance.

A scrape walks history from new to old, so event time runs backwards and a watermark would drop most of it. The jobs
therefore keep what they have seen in tables, not in windowed state: each micro-batch is compared with the stored keys
of its own buckets and appended as one partition. Results do not depend on how deliveries are cut into batches, nor on
how often a delivery is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.functions.scores import ScopeParams
from channelgraph.operators.counts import insert_facts, sum_facts
from channelgraph.operators.coverage import fetch_coverage
from channelgraph.operators.forwards import OCCURRENCE_KEY, forward_edges, forward_occurrences
from channelgraph.operators.merge import MESSAGE_KEY, merge_messages
from channelgraph.operators.scope import (
    SCORES,
    event_counts,
    evidence_pairs,
    forward_events,
    forwarded_images,
    image_scores,
    with_scores,
)
from channelgraph.operators.texts import with_reference
from channelgraph.schemas import COUNT_COLUMNS, MESSAGES, TABLES, TEXT_REF
from channelgraph.session import drop_settled, settle
from channelgraph.sources.archive import conform
from channelgraph.streaming.log import BatchLog

DELIVERIES = T.StructType([*MESSAGES.fields, T.StructField("seq", T.LongType()), T.StructField("text_ref", TEXT_REF)])
KEY_BUCKETS = 256


def read_deliveries(
    spark: SparkSession, path: str, files_per_batch: int = 64, schema: T.StructType = DELIVERIES
) -> DataFrame:
    """A folder of Parquet files as a stream; ``seq`` ranks the deliveries of a message."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work through everything that is there now, batch by batch, and stop."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


# ---- key buckets

def bucket_of(peer: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(peer), F.lit(buckets)).cast("int")


def buckets_in(rows: DataFrame) -> list[int]:
    """Buckets a batch touches, at most as many numbers as there are buckets. A scrape works on few peers at a time, so most are left out."""
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]


def by_bucket(rows: DataFrame, spread: str) -> DataFrame:
    """Rows of a bucket lie together, a busy one over several files."""
    return rows.repartitionByRange("bucket", F.xxhash64(spread)).sortWithinPartitions("bucket")


# ---- messages

class MessageStream:
    """Deliveries are appended as they come; the merged table is the fold of all of them over the base."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = BatchLog(spark, f"{path}/deliveries", DELIVERIES)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(with_reference(batch), batch_id)

    def merged(self, base: DataFrame) -> DataFrame:
        """The archive's messages now."""
        return merge_messages(base, self.log.all().drop("batch_id"), order="seq")

    def compact(self, base: DataFrame, path: str) -> DataFrame:
        """Folds all batches but the newest into a new base at ``path`` and drops them from the log.

        What is in the base counts as older than every delivery that follows, so compact where deliveries of a message
        come in the order of ``seq``.
        """
        cutoff = self.log.newest() or 0
        folded = merge_messages(base, self.log.before(cutoff).drop("batch_id"), order="seq")
        conform(folded, "slim_messages").write.parquet(path)
        self.log.compact(lambda rows: rows.limit(0), cutoff)
        return self.log.spark.read.schema(TABLES["slim_messages"]).parquet(path)


# ---- counters

_KEYS = T.StructType(
    [T.StructField(k, T.LongType()) for k in MESSAGE_KEY] + [T.StructField("bucket", T.IntegerType())]
)
_DELTAS = T.StructType(
    [T.StructField("peer_external_id", T.LongType())]
    + [
        T.StructField(c, T.LongType())
        for c in COUNT_COLUMNS
        if c in ("posts", "text_total") or (c.endswith(("_total", "_downloaded")) and c != "unique_forwards")
    ]
)


class CounterStream:
    """Per-peer counters from messages seen for the first time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = KEY_BUCKETS):
        self.buckets = buckets
        self.keys = BatchLog(spark, f"{path}/keys", _KEYS)
        self.deltas = BatchLog(spark, f"{path}/deltas", _DELTAS)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        # a few facts per message leave the batch; its text is read once and goes no further
        facts = insert_facts(batch, "telegram_message_id", "seq")
        first = facts.groupBy(*MESSAGE_KEY).agg(F.min_by(F.struct("kind", "downloaded", "text"), "seq").alias("row"))
        rows = settle(first.select(*MESSAGE_KEY, "row.*", bucket_of("peer_external_id", self.buckets).alias("bucket")), "facts")
        seen = self.keys.before(batch_id, buckets_in(rows)).select(*MESSAGE_KEY)
        fresh = settle(rows.join(seen, MESSAGE_KEY, "left_anti"), "fresh")
        self.deltas.write(sum_facts(fresh), batch_id)
        self.keys.write(by_bucket(fresh, "telegram_message_id"), batch_id)

        drop_settled(rows)
        drop_settled(fresh)

    def counters(self) -> DataFrame:
        return self._summed(self.deltas.all())

    def _summed(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in self.deltas.columns if c != "peer_external_id"]
        return rows.groupBy("peer_external_id").agg(*[F.sum(c).alias(c) for c in columns])

    def compact(self) -> None:
        self.deltas.compact(self._summed)
        self.keys.compact()


# ---- forwards

_OCCURRENCES = T.StructType([*TABLES["forward_edge_messages"].fields, T.StructField("bucket", T.IntegerType())])


class ForwardStream:
    """Occurrences and edges; a repeated forward adds nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = KEY_BUCKETS):
        self.buckets = buckets
        self.log = BatchLog(spark, f"{path}/occurrences", _OCCURRENCES)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        occ = settle(forward_occurrences(batch).withColumn("bucket", bucket_of("from_external_id", self.buckets)), "occurrences")
        seen = self.log.before(batch_id, buckets_in(occ)).select(*OCCURRENCE_KEY)
        self.log.write(by_bucket(occ.join(seen, OCCURRENCE_KEY, "left_anti"), "message_id"), batch_id)
        drop_settled(occ)

    def compact(self) -> None:
        self.log.compact()

    def occurrences(self) -> DataFrame:
        return self.log.all().drop("batch_id", "bucket")

    def edges(self) -> DataFrame:
        return forward_edges(self.occurrences())


# ---- coverage

class CoverageStream:
    """First and last date per peer. The windows only widen, so late and repeated rows do no harm."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = BatchLog(spark, f"{path}/coverage", TABLES["peer_fetch_coverage"])

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(fetch_coverage(batch), batch_id)

    def coverage(self) -> DataFrame:
        return self._widest(self.log.all())

    def compact(self) -> None:
        self.log.compact(self._widest)

    @staticmethod
    def _widest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("peer_external_id").agg(
            F.min("covered_after").alias("covered_after"), F.max("covered_before").alias("covered_before")
        )


# ---- relevance

_BUCKET = T.StructField("bucket", T.IntegerType())
_EVIDENCE = T.StructType([*TABLES["peer_scope_evidence"].fields, T.StructField("r", T.DoubleType()), _BUCKET])
_EVENTS = T.StructType([*TABLES["peer_scope_forward_events"].fields, _BUCKET])


class RelevanceStream:
    """Scores that grow as the images of peers are embedded. Input: ids of peers that just were."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, DataFrame], params: ScopeParams = ScopeParams(), buckets: int = KEY_BUCKETS):
        self.tables, self.params, self.buckets = tables, params, buckets
        self.evidence = BatchLog(spark, f"{path}/evidence", _EVIDENCE)
        self.events = BatchLog(spark, f"{path}/events", _EVENTS)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        t = self.tables
        chosen = batch.select("peer_external_id").distinct()
        own = t["links"].join(chosen, "peer_external_id", "left_semi")
        senders = chosen.withColumnRenamed("peer_external_id", "from_external_id")
        forwarded = forwarded_images(t["occ"].join(senders, "from_external_id", "left_semi"), t["links"], t["peers"])
        involved = own.select("phash").unionByName(forwarded.select("phash")).distinct()
        scored = image_scores(t["vectors"].join(involved, "phash", "left_semi"), t["inputs"], self.params)
        if scored is None:
            return
        scored, forwarded = settle(scored, "image-scores"), settle(forwarded, "forwarded-images")
        key = ["peer_external_id", "pile", "phash"]
        bucket = bucket_of("peer_external_id", self.buckets)
        pairs = settle(evidence_pairs(own, forwarded, scored).withColumn("bucket", bucket), "evidence")
        known = self.evidence.before(batch_id, buckets_in(pairs)).select(*key)
        fresh = pairs.join(known, key, "left_anti").join(scored.select("phash", "r"), "phash")
        self.evidence.write(by_bucket(fresh, "phash"), batch_id)
        # a message has one origin, so its events are all in that peer's bucket
        events = forward_events(forwarded, t["vectors"]).withColumn("bucket", bucket_of("origin_peer_id", self.buckets))
        events = settle(events, "events")
        known = self.events.before(batch_id, buckets_in(events)).select("message_id", "phash")
        self.events.write(by_bucket(events.join(known, ["message_id", "phash"], "left_anti"), "phash"), batch_id)
        for done in (pairs, events, scored, forwarded):
            drop_settled(done)

    def compact(self) -> None:
        self.evidence.compact()
        self.events.compact()

    def peer_scores(self) -> DataFrame:
        evidence = self.evidence.all()
        sums = (
            evidence.groupBy("peer_external_id").pivot("pile", ["scope", "forward"])
            .agg(F.sum("r").alias("r"), F.count("phash").alias("j"))
        )
        rows = sums.join(event_counts(self.events.all()), "peer_external_id", "full_outer").fillna(0)
        return with_scores(rows.withColumnRenamed("n", "forward_n_events"), self.params).select("peer_external_id", *SCORES)
