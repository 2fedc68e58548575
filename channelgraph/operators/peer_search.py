"""Free-text search over peers through postings of short character strings.

The index holds for every peer the strings of none, one, two and three characters that its title, handle and id contain. A text
of up to three characters is answered by its own postings. Longer ones are met by equality too: where a place of a title,
handle or id begins like some texts do, the strings of their lengths are cut out there and compared with the texts. What is done
so grows with the peers and with what is found, not with texts times peers. Types are few, so a text that is part of one
brings the peers of that type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channelgraph.functions.text import strip

LONGEST = 3
#: Characters at a place that say which longer texts may begin there.
HEAD = LONGEST + 1
#: Peers whose strings one task cuts. Their files are small beside what comes of them, so bytes are no measure.
PEERS_A_TASK = 20_000
SHOWN = ("title", "username", "external_id")


def _field(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def grams(text: Column, size: int) -> Column:
    """The different strings of ``size`` characters in a text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def peer_grams(peers: DataFrame) -> DataFrame:
    """gram, external_id: the strings of one to three characters of each peer, and the empty one."""
    parts = [grams(_field(name), size) for name in SHOWN for size in range(1, LONGEST + 1)]
    held = F.array_distinct(F.concat(F.array(F.lit("")), *parts))
    return peers.select(F.explode(held).alias("gram"), "external_id")


def normal(needle: Column) -> Column:
    """As a single search text is read: ends stripped, small letters, one leading @ gone; null as empty."""
    low = F.lower(strip(F.coalesce(needle, F.lit(""))))
    return F.when(F.startswith(low, F.lit("@")), F.substring(low, F.lit(2), F.length(low))).otherwise(low)


def places(peers: DataFrame) -> DataFrame:
    """head, place, field, external_id: each place of a title, handle or id where a longer text can begin."""
    fields = peers.select("external_id", F.explode(F.array(*[_field(name) for name in SHOWN])).alias("field"))
    starts = F.when(F.length("field") >= HEAD, F.sequence(F.lit(1), F.length("field") - (HEAD - 1)))
    started = fields.select("external_id", "field", F.explode(starts).alias("place"))
    return started.withColumn("head", F.substring(F.col("field"), F.col("place"), F.lit(HEAD)))


class PeerIndex:
    """Postings in order of their string, and what is shown of each peer, at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def build(self, peers: DataFrame) -> PeerIndex:
        """Ranges of (string, peer) split a string that nearly every peer has over several files."""
        shown = peers.select("external_id", "title", "username", "peer_type")
        shown.write.mode("overwrite").parquet(f"{self.root}/peers")
        laid = peer_grams(self._spread()).repartitionByRange(self._tasks(), "gram", "external_id").sortWithinPartitions("gram", "external_id")
        laid.write.mode("overwrite").parquet(f"{self.root}/postings")
        return self

    def peers(self) -> DataFrame:
        return self.spark.read.schema("external_id long, title string, username string, peer_type string").parquet(f"{self.root}/peers")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, external_id long").parquet(f"{self.root}/postings")

    def _tasks(self) -> int:
        return 1 + self.peers().count() // PEERS_A_TASK

    def _spread(self) -> DataFrame:
        return self.peers().repartition(self._tasks(), "external_id")

    def _longer(self, texts: DataFrame) -> DataFrame:
        """text, external_id for texts that have no postings, once for each place."""
        asked = texts.filter(F.length("text") > LONGEST)
        heads = asked.groupBy(F.left("text", F.lit(HEAD)).alias("head")).agg(F.collect_set(F.length("text")).alias("lengths"))
        begun = places(self._spread()).join(heads, "head")
        room = F.length("field") - F.col("place") + 1
        fitting = begun.select("external_id", "field", "place", F.explode(F.filter("lengths", lambda n: n <= room)).alias("n"))
        cut = fitting.select(F.substring(F.col("field"), F.col("place"), F.col("n")).alias("text"), "external_id")
        return cut.join(asked, "text", "left_semi")

    def search(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """needle, external_id: for each different search text the peers that it matches, as ``peer_matches`` defines it."""
        asked = needles.select(F.col(needle).alias("needle")).distinct().withColumn("text", normal(F.col("needle")))
        texts = asked.select("text").distinct()
        # many peers meet one text: the side that has each text once is the one that a join may hold
        short = self.postings().withColumnRenamed("gram", "text").join(texts, "text", "left_semi")
        types = self.peers().select("peer_type").distinct().filter(F.col("peer_type").isNotNull())
        named = texts.filter(F.length("text") > 0).join(types, F.contains(F.lower("peer_type"), F.col("text")))
        by_type = self._spread().select("external_id", "peer_type").join(named, "peer_type")
        found = short.unionByName(self._longer(texts)).filter("external_id IS NOT NULL").unionByName(by_type.select("text", "external_id"))
        # a place or a type may find a peer again; dealt out by both columns first, so that a task keeps its own share only
        once = found.repartition(self._tasks(), "text", "external_id").distinct()
        return once.join(asked, "text").select("needle", "external_id")
