"""Large groups: ranks, layouts and pages that no single task has to hold."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from channelgraph.operators import listing, merge
from channelgraph.operators.images import hit_peers
from channelgraph.operators.ranking import ranked_within


def test_ranks_within_a_group_over_many_ranges(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 30 > 0, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for groups in (["g"], []):
            got = ranked_within(df, groups, [F.desc("v"), F.asc("id")], "place")
            assert got.columns == ["g", "v", "id", "place"]
            seen = Counter()
            want = {}
            for r in sorted(df.collect(), key=lambda r: (-r["v"], r["id"])):
                key = r["g"] if groups else None
                seen[key] += 1
                want[r["id"]] = seen[key]
            assert {r["id"]: r["place"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked_within(df.limit(0), ["g"], [F.asc("v")], "place").collect() == []


def test_the_peers_of_a_viral_image(spark):
    n = 3000
    links = spark.range(n).select(F.lit("aaaaaaaaaaaaaaaa").alias("phash"), F.col("id").alias("message_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("message_date"), (-F.col("id") % 1500 - 1).alias("peer_external_id"), F.col("id").alias("telegram_message_id"))
    messages = spark.range(n).select("id", F.lit(None).cast("string").alias("fwd_from"))
    peers = links.select(F.col("peer_external_id").alias("external_id"), F.lit("channel").alias("peer_type"), F.lit("t").alias("title")).distinct()
    hits = spark.createDataFrame([(1, "aaaaaaaaaaaaaaaa"), (2, "aaaaaaaaaaaaaaaa"), (2, "bbbbbbbbbbbbbbbb")], "query_id long, phash string")
    rows = hit_peers(hits, links, messages, peers).collect()
    for q in (1, 2):
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and len(own) == peers.count()
        order = [(-r["appearances"], -r["last_seen_at"].timestamp(), r["peer_external_id"]) for r in own]
        assert order == sorted(order)


def test_a_busy_peer_lies_in_several_files(spark, archive, tmp_path):
    """A third of a month's rows are one peer's; its folder must not be one file."""
    one = archive.messages.filter("date >= '2024-01-01' AND date < '2024-02-01'")
    hot = one.withColumn("peer_external_id", F.when(F.col("id") % 3 == 0, F.lit(-1000000000001)).otherwise(F.col("peer_external_id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        merge.write_by_month(hot, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "m")).filter("peer_external_id = -1000000000001").select(F.input_file_name().alias("f")).distinct()
    assert files.count() > 1


def test_pages_over_ties_repeat_and_lose_nothing(spark):
    """Two peers share dates and message numbers; the id orders them."""
    rows = spark.range(200).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("date"), (F.col("id") % 5).alias("telegram_message_id"), F.lit(-1).alias("peer_external_id"))
    order = ["date", "telegram_message_id", "id"]
    want = [(r["telegram_message_id"], r["id"]) for r in rows.orderBy(*listing.message_order()).collect()]
    offset, after, last = [], [], ("9999-01-01 00:00:00", 0, 0)
    for start in range(0, 200, 40):
        offset += listing.page(rows, listing.message_order(), 40, start).collect()
        page = listing.page_after(rows, order, last, 40).collect()
        after += page
        last = (str(page[-1]["date"]), page[-1]["telegram_message_id"], page[-1]["id"])
    assert [(r["telegram_message_id"], r["id"]) for r in offset] == want == [(r["telegram_message_id"], r["id"]) for r in after]
