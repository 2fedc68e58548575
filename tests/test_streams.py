"""State kept by the engine over restarts and replays; batch logs that lose nothing to a compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from channelgraph.operators.counts import message_deltas
from channelgraph.operators.forwards import forward_edges, forward_occurrences
from channelgraph.operators.images import blob_flags
from channelgraph.streaming import engine, jobs, live
from channelgraph.streaming.log import BatchLog


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def parts(archive, tmp_path):
    """The archive's messages as three files, delivered one after the other and all of them again."""
    columns = jobs.DELIVERIES.fieldNames()
    messages = archive.messages.withColumn("seq", F.col("id")).select(*columns)

    def deliver(n):
        part = messages.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == n % 3) if n < 3 else messages
        part.withColumn("seq", F.col("seq") + n).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    return deliver


def test_state_survives_restarts_and_repeats(spark, archive, parts, tmp_path):
    counters, edges = (make(spark, str(tmp_path / name)) for make, name in ((engine.counter_store, "c"), (engine.edge_store, "e")))
    for n in (0, 1, 3, 2):  # the whole archive comes again before its last part
        parts(n)
        stream = jobs.read_deliveries(spark, str(tmp_path / "in"), files_per_batch=1)
        # a new object each time: what was seen is in the checkpoint alone
        counters, edges = engine.counter_store(spark, str(tmp_path / "c")), engine.edge_store(spark, str(tmp_path / "e"))
        counters.run(engine.counter_totals(stream), str(tmp_path / "check-c"))
        edges.run(engine.edge_totals(stream), str(tmp_path / "check-e"))
        if n == 1:
            counters.compact()
    assert rows(counters.totals()) == rows(message_deltas(archive.messages))
    assert rows(edges.totals()) == rows(forward_edges(forward_occurrences(archive.messages)))
    # a batch that the sink has seen already, run once more
    last = counters.log.newest()
    before = rows(counters.totals())
    schema = counters.log.all().drop("batch_id").schema
    again = spark.createDataFrame(counters.log.all().filter(F.col("batch_id") == last).drop("batch_id").collect(), schema)
    counters._keep(again, last)
    assert rows(counters.totals()) == before
    counters.compact()
    assert rows(counters.totals()) == before


def batch(spark, n):
    return spark.createDataFrame([(n, 10 * n)], "k long, v long")


def ids(log):
    return sorted(r["k"] for r in log.all().collect())


def test_a_batch_committed_while_compacting(spark, tmp_path):
    """Between the choice of the cutoff and the new generation, and by a writer of its own."""
    log = BatchLog(spark, str(tmp_path / "log"), batch(spark, 0).schema)
    for n in range(3):
        log.write(batch(spark, n), n)
    other = BatchLog(spark, str(tmp_path / "log"), batch(spark, 0).schema)

    def fold(old):
        other.write(batch(spark, 3), 3)
        return old

    log.compact(fold)
    assert ids(log) == ids(other) == [0, 1, 2, 3]
    other.write(batch(spark, 4), 4)
    assert ids(log) == [0, 1, 2, 3, 4]
    log.compact()
    assert ids(other) == [0, 1, 2, 3, 4] and sorted({r["batch_id"] for r in other.all().collect()}) == [3, 4]


def test_a_write_that_a_compaction_overtakes(spark, tmp_path, monkeypatch):
    """The new generation is marked after the writer chose the old one: it writes again."""
    log, other = (BatchLog(spark, str(tmp_path / "log"), batch(spark, 0).schema) for _ in range(2))
    for n in range(2):
        log.write(batch(spark, n), n)
    save, done = other._save, []

    def slow(df, folder, mode):
        if not done:
            done.append(folder)
            log.compact()
        save(df, folder, mode)

    monkeypatch.setattr(other, "_save", slow)
    other.write(batch(spark, 2), 2)
    assert ids(log) == [0, 1, 2] and done[0] != log._folder(log.generation)


def test_message_base_and_log_miss_no_batch(spark, archive, tmp_path, monkeypatch):
    """A batch that arrives between the fold into the base and the compaction of the log is in neither, unless one cutoff holds for both."""
    store = jobs.MessageStream(spark, str(tmp_path / "m"))
    messages = archive.messages.withColumn("seq", F.col("id"))
    parts = [messages.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == n) for n in range(4)]
    for n in range(3):
        store.on_batch(parts[n], n)
    compact = store.log.compact

    def late(*args, **kwargs):
        store.on_batch(parts[3], 3)
        compact(*args, **kwargs)

    monkeypatch.setattr(store.log, "compact", late)
    base = store.compact(archive.messages.limit(0), str(tmp_path / "base"))
    assert store.merged(base).count() == archive.messages.count()
    assert sorted({r[0] for r in store.log.all().select("batch_id").distinct().collect()}) == [2, 3]


def test_live_counters_over_replays_and_compaction(spark, archive, tmp_path):
    """Batches that overlap, run twice and are compacted in between leave the twenty counters of the full recount."""
    messages = archive.messages.withColumn("seq", F.col("id"))
    flags = blob_flags(archive.image_blobs, archive.image_cache, trim_paths=False)
    store = live.LiveCounters(spark, str(tmp_path / "live"), buckets=2)
    # facts first know less, then all; and of some images they come before the messages
    early = flags.filter("phash < '8'").withColumns({"embedded": F.lit(False), "persisted": F.lit(None).cast("boolean")})
    store.on_blobs(early, 0)
    for n, batch_id in ((0, 0), (1, 1), (1, 1), (2, 2)):
        store.on_batch(messages.filter(F.pmod(F.xxhash64("id"), F.lit(3)) <= n), batch_id)
        if n == 1:
            store.compact()
    store.on_blobs(flags, 1)
    store.on_blobs(flags, 1)
    again = live.LiveCounters(spark, str(tmp_path / "live"), buckets=2)
    assert rows(again.counters()) == rows(archive.peer_counts)
    numbers = [r["number"] for r in again.images.numbers.all().collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
