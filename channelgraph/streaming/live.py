"""All twenty counters of a peer kept up as messages and image facts arrive.

Sums are deltas of messages seen for the first time. Distinct counts (images of a peer, origins it forwards from) are exact
bitmaps: each image and each origin gets the next free number when it is first seen, and a peer has one word of 64 bits
for each 64 numbers it touches. Words are plain numbers, so that a peer with few items among very many takes a few bytes for
each, and nothing is sorted to merge them. Those of several batches merge by OR. Facts of images that come later (stored,
embedded) make words over the same numbers: AND with those of a peer and a count of bits give its counters, and no message
is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.functions.forwards import fwd_origin
from channelgraph.functions.media import has_phash, is_downloaded, media_kind
from channelgraph.functions.text import has_words, is_dedupable, norm_phash
from channelgraph.operators.counts import sum_facts
from channelgraph.operators.forwards import is_occurrence
from channelgraph.operators.merge import MESSAGE_KEY
from channelgraph.operators.ranking import ranked_within
from channelgraph.schemas import COUNT_COLUMNS
from channelgraph.session import drop_settled, settle
from channelgraph.streaming.jobs import KEY_BUCKETS, bucket_of, buckets_in, by_bucket
from channelgraph.streaming.log import BatchLog

_long = T.LongType()
_bucket = T.StructField("bucket", T.IntegerType())
SUMS = tuple(c for c in COUNT_COLUMNS if c not in ("image_unique", "image_persisted", "image_embeddable", "image_embedded_unique", "unique_forwards"))
#: Facts of an image; the counter of each. ``shown`` holds for every image that is known at all.
FACTS = {"shown": "image_unique", "persisted": "image_persisted", "embeddable": "image_embeddable", "embedded": "image_embedded_unique"}
FLAGS = T.StructType([T.StructField("phash", T.StringType()), *[T.StructField(f, T.BooleanType()) for f in ("persisted", "embeddable", "embedded")]])
_KEYS = T.StructType([*[T.StructField(k, _long) for k in MESSAGE_KEY], _bucket])
_DELTAS = T.StructType([T.StructField("peer_external_id", _long), *[T.StructField(c, _long) for c in SUMS]])
_NUMBERS = T.StructType([T.StructField("item", T.StringType()), T.StructField("number", _long), _bucket])
_BITS = T.StructType([T.StructField("peer_external_id", _long), T.StructField("part", _long), T.StructField("bits", _long)])
#: A number is one bit of the word ``part``.
_PART, _BIT = "shiftright(number, 6)", "shiftleft(1L, CAST(number & 63 AS INT))"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("peer_external_id", "part").agg(F.bit_or("bits").alias("bits"))


class _DistinctItems:
    """For each peer the set of items it has had, exact."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.buckets = buckets
        self.numbers = BatchLog(spark, f"{path}/numbers", _NUMBERS)
        self.bits = BatchLog(spark, f"{path}/bits", _BITS)

    def add(self, pairs: DataFrame, batch_id: int) -> None:
        """``pairs``: peer_external_id and item (text). Items seen for the first time get the numbers after the last one given."""
        items = settle(pairs.select("item").distinct().withColumn("bucket", bucket_of("item", self.buckets)), "items")
        seen = self.numbers.before(batch_id, buckets_in(items)).select("item", "number")
        last = self.numbers.before(batch_id).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        ranked = ranked_within(items.join(seen, "item", "left_anti"), [], [F.col("item")], "place")
        new = settle(ranked.select("item", (F.col("place") + last).cast("long").alias("number"), "bucket"), "numbers")
        drop_settled(ranked)
        self.numbers.write(by_bucket(new, "item"), batch_id)
        known = seen.join(items, "item", "left_semi").unionByName(new.select("item", "number"))
        self.bits.write(_merged(pairs.join(known, "item").selectExpr("peer_external_id", f"{_PART} AS part", f"{_BIT} AS bits")), batch_id)
        drop_settled(items)
        drop_settled(new)

    def merged(self) -> DataFrame:
        return _merged(self.bits.all())

    def compact(self) -> None:
        self.numbers.compact()
        self.bits.compact(_merged)


class LiveCounters:
    """Messages by ``on_batch``, facts of images by ``on_blobs`` (two streams, each with batch numbers of its own).

    Batches that run again and deliveries that repeat change nothing. A fact of an image holds from the first row that
    states it; images without any row of facts are not counted, as in the full recount.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = KEY_BUCKETS):
        self.buckets = buckets
        self.keys = BatchLog(spark, f"{path}/keys", _KEYS)
        self.deltas = BatchLog(spark, f"{path}/deltas", _DELTAS)
        self.blobs = BatchLog(spark, f"{path}/blobs", FLAGS)
        self.images = _DistinctItems(spark, f"{path}/images", buckets)
        self.origins = _DistinctItems(spark, f"{path}/origins", buckets)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        media = F.col("media")
        linked = is_dedupable(media["phash"]) & F.col("id").isNotNull() & F.col("date").isNotNull() & F.col("peer_external_id").isNotNull()
        facts = batch.select(
            *MESSAGE_KEY, "seq", media_kind(media).alias("kind"), is_downloaded(media).alias("downloaded"),
            has_words(batch.columns).alias("text"), "text_embedded", has_phash(media).alias("hashed"),
            F.when(linked, norm_phash(media["phash"])).alias("phash"), F.when(is_occurrence(), fwd_origin(F.col("fwd_from"))).alias("origin"),
        )
        columns = [c for c in facts.columns if c not in (*MESSAGE_KEY, "seq")]
        first = facts.groupBy(*MESSAGE_KEY).agg(F.min_by(F.struct(*columns), "seq").alias("row"))
        rows = settle(first.select(*MESSAGE_KEY, "row.*", bucket_of("peer_external_id", self.buckets).alias("bucket")), "facts")
        seen = self.keys.before(batch_id, buckets_in(rows)).select(*MESSAGE_KEY)
        fresh = settle(rows.join(seen, MESSAGE_KEY, "left_anti"), "fresh")
        self.deltas.write(self._sums(fresh), batch_id)
        self.images.add(fresh.filter("phash IS NOT NULL").select("peer_external_id", F.col("phash").alias("item")).distinct(), batch_id)
        self.origins.add(fresh.filter("origin IS NOT NULL").select("peer_external_id", F.col("origin").cast("string").alias("item")).distinct(), batch_id)
        # last: a batch whose keys are there has been counted in full
        self.keys.write(by_bucket(fresh, "telegram_message_id"), batch_id)
        drop_settled(rows)
        drop_settled(fresh)

    def on_blobs(self, batch: DataFrame, batch_id: int) -> None:
        self.blobs.write(batch, batch_id)

    def compact(self) -> None:
        self.keys.compact()
        self.deltas.compact(self._summed)
        self.images.compact()
        self.origins.compact()

    def counters(self) -> DataFrame:
        """The twenty counters of every peer seen so far."""
        origins = self.origins.merged().groupBy("peer_external_id").agg(F.sum(F.bit_count("bits")).alias("unique_forwards"))
        parts = [self._summed(self.deltas.all()), self._image_counts(), origins]
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return stacked.groupBy("peer_external_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNT_COLUMNS])

    def _image_counts(self) -> DataFrame:
        names = [f for f in FACTS if f != "shown"]
        held = self.blobs.all().groupBy("phash").agg(*[F.max(f).alias(f) for f in names]).withColumn("shown", F.lit(True))
        numbers = self.images.numbers.all().select(F.col("item").alias("phash"), "number")
        masks = numbers.join(held, "phash").groupBy(F.expr(_PART).alias("part")).agg(*[F.bit_or(F.when(F.col(f), F.expr(_BIT))).alias(f) for f in FACTS])
        both = self.images.merged().join(masks, "part")
        return both.groupBy("peer_external_id").agg(*[F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col(f)))).alias(c) for f, c in FACTS.items()])

    def _sums(self, fresh: DataFrame) -> DataFrame:
        def count(test: Column, name: str) -> Column:
            return F.count(F.when(test, 1)).alias(name)

        more = fresh.groupBy("peer_external_id").agg(
            count(F.col("text") & F.col("text_embedded"), "text_embedded"),
            count((F.col("kind") == "image") & F.col("hashed"), "image_hashed"),
            count(F.col("origin").isNotNull(), "total_forwards"),
        )
        return self._summed(sum_facts(fresh).unionByName(more, allowMissingColumns=True))

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("peer_external_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])
