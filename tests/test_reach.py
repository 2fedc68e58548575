"""Rounds over bitmaps reach what a plain breadth-first walk does."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from channelgraph.operators import expand, reach

EDGES, SEEDS = "from_external_id long, to_external_id long", "peer_id long"


def walk(edges, seeds, most=None):
    found, frontier, depth = {s: (None, 0) for s in seeds}, set(seeds), 0
    while frontier and (most is None or depth < most):
        depth += 1
        met = {}
        for a, b in edges:
            if a in frontier and b not in found and b < 0:
                met[b] = min(a, met.get(b, a))
        found |= {b: (a, depth) for b, a in met.items()}
        frontier = set(met)
    return found


def got(df):
    rows = df.collect()
    found = {r["peer_id"]: (r["via"], r["depth"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_graphs(spark):
    for seed, peers, lines in ((1, 60, 90), (2, 400, 500)):
        draw = random.Random(seed)
        ids = [-(10**12) - draw.randrange(10**9) for _ in range(peers)] + [5, 77, -3]
        edges = [(draw.choice(ids), draw.choice(ids)) for _ in range(lines)]
        seeds = draw.sample(ids, 4) + [-999]
        frame = spark.createDataFrame([*edges, *edges[:20], (None, ids[0]), (ids[0], None)], EDGES)
        start = spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], SEEDS)
        assert got(reach.reach(frame, start)) == walk(edges, seeds)
        for depth in (0, 2):
            assert got(reach.reach(frame, start, depth)) == walk(edges, seeds, depth)


def test_bits_of_several_parts(spark):
    held = sorted({1, 2, 8, 9, 32767, 32768, 32769, 65536, 65537, 200_000, *random.Random(3).sample(range(1, 300_000), 500)})
    maps = reach.bitmaps(spark.createDataFrame([(n,) for n in held], "number long"))
    assert maps.count() <= 10
    asked = spark.range(1, 300_001).withColumnRenamed("id", "number").withColumn("part", F.bitmap_bucket_number("number"))
    found = asked.join(maps, "part", "left").filter(reach.has_bit(F.col("bits"), F.col("number")))
    assert sorted(r[0] for r in found.select("number").collect()) == held


def test_equals_the_expansion_of_the_archive(spark, archive):
    seeds = archive.peers.filter("external_id < 0 AND abs(external_id) % 10 = 1").select(F.col("external_id").alias("peer_id"))
    assert got(reach.reach(archive.forward_edges, seeds)) == got(expand.expand(archive.forward_edges, seeds).select("peer_id", "via", "depth"))


def test_nothing_to_start_from(spark):
    edges = spark.createDataFrame([(-1, -2)], EDGES)
    assert got(reach.reach(edges, spark.createDataFrame([], SEEDS))) == {}
    assert got(reach.reach(edges.limit(0), spark.createDataFrame([(-4,)], SEEDS))) == {-4: (None, 0)}


def test_a_round_moves_its_frontier_only(spark, archive, monkeypatch):
    """Edges lie in buckets by poster: their side of the join is neither sent nor sorted. Tables go when the rounds fail too."""
    plans = []

    def rounds(lines, start, numbered, max_depth):
        frontier = start.join(numbered, "peer_id").select(F.col("number").alias("source")).hint("shuffle_merge")
        plans.append(spark._jvm.PythonSQLUtils.explainString(lines.join(frontier, "source")._jdf.queryExecution(), "simple"))
        raise RuntimeError("lost")

    monkeypatch.setattr(reach, "_rounds", rounds)
    before = {t.name for t in spark.catalog.listTables()}
    seeds = archive.peers.select(F.col("external_id").alias("peer_id"))
    try:
        reach.reach(archive.forward_edges, seeds)
    except RuntimeError:
        pass
    assert {t.name for t in spark.catalog.listTables()} == before
    # the side of the edges, which stands first under the last join
    side = plans[0].split("SortMergeJoin", 1)[1]
    edges = side[: side.index("Scan parquet spark_catalog")]
    assert "Exchange" not in edges
