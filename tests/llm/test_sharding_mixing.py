import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from channelgraph.llm import mixing, sharding

ROWS = [(i, None if i % 17 == 0 else "" if i % 19 == 0 else f"tëxt {i % 40}", None if i % 23 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
ROWS += [(5, "twice", "hot"), (5, "twice", "hot"), (None, None, None)]


def test_shards(docs_of, clashing):
    rows = sharding.interleave(clashing(docs_of(ROWS)), 16).collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter((i, s) for i, _, s in ROWS)
    texts = defaultdict(set)
    for i, t, _ in ROWS:
        texts[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in rows)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    sizes = [len(by_shard[s]) for s in range(16)]
    assert set(by_shard) == set(range(16)) and max(sizes) - min(sizes) <= 1
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    for source, n in Counter(s for *_, s in ROWS).items():
        shares = [sum(r["source"] == source for r in by_shard[s]) for s in range(16)]
        assert max(shares) - min(shares) <= 2, (source, n, shares)


def brute_shards(rows, shards):
    """id, size, checksum, shard and slot by sorting everything at once."""
    keyed = []
    for i, text, source in rows:
        data = (text or "").encode()
        key = hashlib.md5(f"shards:{'' if i is None else i}".encode()).hexdigest()
        keyed.append((source, (key, i is not None, i or 0, len(data) + 1, zlib.crc32(data))))
    placed = []
    for source in {s for s, _ in keyed}:
        own = sorted(t for s, t in keyed if s == source)
        placed += [((2 * r - 1) / (2 * len(own)), source is not None, source or "", t) for r, t in enumerate(own, 1)]
    out, seen = [], Counter()
    for place, (_, _, _, (_, known, i, size, crc)) in enumerate(sorted(placed)):
        shard = place * shards // len(placed)
        out.append((i if known else None, size, crc, shard, seen[shard]))
        seen[shard] += 1
    return out


@pytest.mark.parametrize("shards", [16, 7])
def test_shards_against_one_sort(spark, docs_of, shards):
    """Also with very long texts and with a thousand sources of one row, which all stand at one half."""
    rows = ROWS + [(5000 + i, f"only {i}", f"single {i}") for i in range(1000)] + [(9000, "long " * 100_000, "hot")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.interleave(docs_of(rows), shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_shards(rows, shards)))


def test_shards_of_few_rows(docs_of):
    assert sharding.interleave(docs_of([]), 16).collect() == []
    rows = sharding.interleave(docs_of([(1, "a"), (2, "b")]), 16).collect()
    assert sorted(r["slot"] for r in rows) == [0, 0] and len({r["shard"] for r in rows}) == 2


def test_the_same_shards_again(docs_of):
    pick = ["doc_id", "size", "shard", "slot"]
    one = sharding.interleave(docs_of(ROWS[:900]), 7).select(pick).collect()
    two = sharding.interleave(docs_of(ROWS[:900][::-1]).repartition(11), 7).select(pick).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_poisson_inversion(spark):
    for mean in (0.0, 0.1, 1.0, 7.5, 60.0):
        cdf = spark.range(1).select(mixing._cdf(F.lit(mean)).alias("c")).first()["c"]
        total = 0.0
        for k, c in enumerate(cdf):
            total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean else float(k == 0)
            assert abs(c - total) < 1e-9
        assert cdf[-1] > 1 - 1e-12


def test_mixture_meets_the_weights(docs_of):
    docs = docs_of([(i, f"t{i}", "a" if i % 4 else "b") for i in range(4000)])
    # a source without documents takes no share from the others
    out = mixing.mix(docs, {"a": 1.0, "b": 3.0, "absent": 5.0}, rows=4000)
    got = Counter(r["source"] for r in out.collect())
    assert abs(got["a"] - 1000) < 200 and abs(got["b"] - 3000) < 300


def test_high_rates_have_whole_copies(docs_of):
    rows = mixing.replicate(docs_of([(i, "t", "a") for i in range(50)]), {"a": 1.0}, rows=50 * 300).collect()
    counts = Counter(r["row"]["doc_id"] for r in rows)
    assert len(counts) == 50 and min(counts.values()) >= 236 and abs(len(rows) - 15000) < 700


def test_mixing_edge_rows(docs_of, clashing):
    df = clashing(docs_of(ROWS))
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert set(got) <= {(i, s) for i, _, s in ROWS} and abs(sum(got.values()) - len(ROWS)) < 200
    assert mixing.mix(docs_of([])).collect() == []
    dealt = mixing.replicate(docs_of([(7, "x"), (7, "x")]), rows=20).collect()
    assert len({r["n_copies"] for r in dealt}) == 1


def test_joined_rates_give_the_same(docs_of, monkeypatch):
    docs = docs_of(ROWS)
    pick = ["row.doc_id", "row.source", "copy", "shuffle_key"]
    one = sorted(map(str, mixing.replicate(docs).select(pick).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert one == sorted(map(str, mixing.replicate(docs).select(pick).collect()))
