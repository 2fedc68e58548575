"""Partial aggregates by month: totals equal a recount, and only touched months are written."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from channelgraph.operators import merge, partials
from channelgraph.operators.coverage import fetch_coverage
from channelgraph.sources.derived import message_base, redelivered_messages


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def files(root):
    return {os.path.join(top, f) for top, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_only_touched_months_are_aggregated_again(spark, archive, tmp_path):
    by_month, root = str(tmp_path / "messages"), str(tmp_path / "partials")
    late = F.col("date") + F.expr("INTERVAL 40 DAYS")
    spread = archive.messages.withColumn("date", F.when(F.col("id") % 3 == 0, late).otherwise(F.col("date")))
    merge.write_by_month(spread, by_month)
    kept = partials.MonthlyPartials(spark, by_month, root)
    kept.rebuild()
    months = sorted(r[0] for r in spark.read.parquet(by_month).select("month").distinct().collect())
    assert len(months) > 1
    before = files(root)
    # a delivery whose messages are all stored in, or new to, the first month
    delta = redelivered_messages(message_base(archive.source)).filter(merge.month_of() == months[0])
    delta = delta.filter((F.col("id") - 10_000_000) % 3 != 0)
    assert kept.write_back(delta) == months[:1]
    after = files(root)
    other = lambda names: {f for f in names if f"month={months[0]}" not in f}
    assert other(before) == other(after) and before != after
    stored = spark.read.parquet(by_month).drop("month")
    assert stored.count() > archive.messages.count()
    assert rows(kept.peers()) == rows(partials.peer_partials(stored))
    recount = partials.image_partials(stored).groupBy("phash").agg(
        F.sum("appearances").alias("appearances"), F.count("peer_external_id").alias("unique_peers"), F.max("last_seen_at").alias("last_seen_at")
    )
    assert rows(kept.images()) == rows(recount)
    assert rows(kept.peers().select("peer_external_id", "covered_after", "covered_before")) == rows(fetch_coverage(stored))
    # the plan of a total reads partials, not messages
    assert by_month not in kept.peers()._jdf.queryExecution().executedPlan().toString()
