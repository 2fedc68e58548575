"""Pages found by counts are the slices that OFFSET and LIMIT cut, and only the months they lie in are opened."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from channelgraph.operators import listing, merge
from channelgraph.operators.offset_index import OffsetIndex
from channelgraph.sources.derived import message_base, redelivered_messages

REQUESTS = "page string, peer long, offset long, limit long"


@pytest.fixture(scope="module")
def index(spark, archive, tmp_path_factory):
    root = tmp_path_factory.mktemp("offsets")
    # many ties in date and number, several months, and messages without a date
    late = F.col("date") + F.expr("INTERVAL 40 DAYS")
    date = F.when(F.col("id") % 3 == 0, late).when(F.col("id") % 50 != 7, F.date_trunc("hour", "date").cast("timestamp_ntz"))
    messages = archive.messages.withColumn("date", date).withColumn("telegram_message_id", F.col("telegram_message_id") - F.col("telegram_message_id") % 2)
    merge.write_by_month(messages, str(root / "messages"))
    made = OffsetIndex(spark, str(root / "messages"), str(root / "counts"))
    made.rebuild()
    return made


def listed(index, peers):
    rows = index.stored().join(peers.select(F.col("external_id").alias("peer_external_id")), "peer_external_id", "left_semi")
    return [(r["id"], r["peer_external_id"]) for r in rows.orderBy(*listing.message_order()).select("id", "peer_external_id").collect()]


def check(spark, index, peers):
    whole = listed(index, peers)
    n = len(whole)
    busy = max({p for _, p in whole}, key=[p for _, p in whole].count)
    quiet = min({p for _, p in whole}, key=[p for _, p in whole].count)
    asked = [(None, o, k) for o in (0, 1, 7, n // 2, n - 3, n - 1, n, n + 5) for k in (0, 1, 10, 200)]
    asked += [(p, o, k) for p in (busy, quiet, 123_456_789) for o in (0, 2, 5, 1000) for k in (1, 4)]
    asked += [(None, 3, n), (busy, 0, n)]
    requests = spark.createDataFrame([(str(i), *a) for i, a in enumerate(asked)], REQUESTS)
    found = {}
    for r in index.pages(requests, peers).collect():
        found.setdefault(r["page"], []).append((r["place"], r["id"]))
    for i, (peer, offset, limit) in enumerate(asked):
        ids = [m for m, p in whole if peer is None or p == peer]
        assert sorted(found.get(str(i), [])) == list(enumerate(ids))[offset : offset + limit], asked[i]


def test_pages_equal_offset_and_limit(spark, archive, index):
    check(spark, index, archive.peers)
    check(spark, index, archive.peers.filter(F.col("external_id") % 2 == 0))


def test_pages_after_a_delivery(spark, archive, index):
    before = index.table().agg(F.sum("n")).first()[0]
    delta = redelivered_messages(message_base(archive.source)).filter(F.col("id") % 4 == 3)
    assert index.write_back(delta)
    assert index.table().agg(F.sum("n")).first()[0] == index.stored().count() > before
    check(spark, index, archive.peers)


def test_one_page_opens_one_month(spark, index, monkeypatch):
    plans = []
    stored = index.stored
    monkeypatch.setattr(index, "stored", lambda: plans.append(1) or stored())
    page = index.pages(spark.createDataFrame([("p", None, 5, 5)], REQUESTS))
    text = spark._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    assert plans == [1] and "content" not in text
    filters = [line for line in text.splitlines() if line.startswith("PartitionFilters:") and "month" in line]
    newest = max(r["month"] for r in stored().select("month").distinct().collect() if r["month"] != "none")
    assert filters and all(f"= {newest})" in line for line in filters)
    assert page.count() == 5


def test_no_messages(spark, archive, tmp_path):
    merge.write_by_month(archive.messages.limit(1), str(tmp_path / "m"))
    index = OffsetIndex(spark, str(tmp_path / "m"), str(tmp_path / "c"))
    index.rebuild()
    assert index.pages(spark.createDataFrame([], REQUESTS)).collect() == []
    assert index.pages(spark.createDataFrame([("p", None, 1, 5)], REQUESTS)).collect() == []
