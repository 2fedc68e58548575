"""Distinct counts kept as words of 64 bits: exact at the borders of words, and a few bytes for each peer and image."""

from __future__ import annotations

from channelgraph.streaming import live

ITEMS = 200


def pairs(spark, batch):
    return spark.createDataFrame([(peer, f"{item:016x}") for peer, item in batch], "peer_external_id long, item string")


def filled(spark, tmp_path):
    """Three batches that overlap, one of them run twice. Items are numbered from 1 as they come."""
    store = live.LiveCounters(spark, str(tmp_path / "live"), buckets=2)
    batches = [
        [(1, n) for n in range(64)] + [(2, 62), (2, 63)],
        [(1, n) for n in range(60, 130)] + [(3, n) for n in range(0, 130, 3)] + [(-4, 127)],
        [(3, n) for n in range(100, ITEMS)] + [(2, 63), (2, 191)],
    ]
    for batch_id, batch in [(0, batches[0]), (1, batches[1]), (1, batches[1]), (2, batches[2])]:
        store.images.add(pairs(spark, batch), batch_id)
    flags = [(f"{n:016x}", n % 2 == 0, None if n % 5 == 0 else n % 3 == 0, n in (62, 63, 64, 127)) for n in range(ITEMS) if n % 7]
    store.on_blobs(spark.createDataFrame(flags, live.FLAGS), 0)
    return store, {p for batch in batches for p in batch}


def test_words_count_what_sets_count(spark, tmp_path):
    store, held = filled(spark, tmp_path)
    numbers = sorted(r["number"] for r in store.images.numbers.all().collect())
    assert numbers == list(range(1, ITEMS + 1))
    want = {}
    for peer, n in held:
        if n % 7:
            row = want.setdefault(peer, [0, 0, 0, 0])
            for place, fact in enumerate((True, n % 2 == 0, n % 5 != 0 and n % 3 == 0, n in (62, 63, 64, 127))):
                row[place] += fact
    columns = ["image_unique", "image_persisted", "image_embeddable", "image_embedded_unique"]
    found = store.counters().select("peer_external_id", *columns).collect()
    assert {r[0]: list(r[1:]) for r in found if any(r[1:])} == {p: c for p, c in want.items() if any(c)}
    store.compact()
    assert sorted(store.counters().collect()) == sorted(live.LiveCounters(spark, str(tmp_path / "live"), buckets=2).counters().collect())


def test_a_peer_and_image_take_a_few_bytes(spark, tmp_path):
    """Bitmaps of 4 KB were sorted for each fact of each peer and image, which filled the disk."""
    store, held = filled(spark, tmp_path)
    bits = store.images.bits.all()
    assert {bits.schema[c].dataType.typeName() for c in ("peer_external_id", "part", "bits")} == {"long"}
    assert bits.count() <= len(held)
    plan = spark._jvm.PythonSQLUtils.explainString(store.counters()._jdf.queryExecution(), "formatted")
    assert "SortAggregate" not in plan and "Generate" not in plan
