"""What must hold whatever the data: idempotence, agreement of increments with rebuilds, skew, and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelgraph.functions.scores import ScopeParams
from channelgraph.operators import counts, encode, expand, knn, merge, scope
from channelgraph.plans import exports
from channelgraph.plans.queries import QUERIES
from channelgraph.schemas import COUNT_COLUMNS, MESSAGES, TABLES
from channelgraph.sources.derived import message_base, redelivered_messages
from channelgraph.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def core(df):
    return df.select(*MESSAGES.fieldNames())


def test_merge_is_idempotent(archive):
    delta = core(redelivered_messages(message_base(archive.source)))
    once = core(merge.merge_messages(archive.messages, delta, strict_kind=False))
    twice = core(merge.merge_messages(once, delta, strict_kind=False))
    # the strict rule may clear media on any redelivery, so only the lenient form is a fixed point
    assert rows(once) == rows(twice)


@pytest.mark.parametrize("strict", [True, False])
def test_fold_equals_one_by_one(spark, archive, strict):
    """Several deliveries at once leave what applying them in turn leaves."""
    base = message_base(archive.source).filter("event_id < 200")
    first = core(redelivered_messages(base))
    second = first.withColumn("content", F.concat(F.lit("2 "), "content")).withColumn(
        "media", F.when(F.col("telegram_message_id") % 3 == 0, F.col("media").withField("kind", F.lit("gif")).withField("path", F.lit("p")))
    )
    third = first.withColumn("content", F.lit("3")).withColumn(
        "media", F.when(F.col("telegram_message_id") % 4 < 2, F.col("media").withField("width", F.lit("33")))
    )
    start = core(archive.messages.filter("id < 200"))
    step = start
    for delta in (first, second, third):
        step = core(merge.merge_messages(step, delta, strict_kind=strict))
    deliveries = (
        first.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2))).unionByName(third.withColumn("seq", F.lit(3)))
    )
    empty = spark.createDataFrame([], MESSAGES)
    from_nothing = core(merge.merge_messages(empty, start.withColumn("seq", F.lit(0)).unionByName(deliveries), "seq", strict))
    flags = ("text_embedded", "image_embedded")
    assert rows(from_nothing.drop(*flags)) == rows(step.drop(*flags))
    over_stored = core(merge.merge_messages(start, deliveries, "seq", strict))
    assert rows(over_stored) == rows(step)


def test_deltas_add_up_to_the_recount(spark, archive):
    deltas = counts.message_deltas(archive.messages)
    empty = spark.createDataFrame([], TABLES["peer_counts"])
    half = archive.messages.filter("id % 2 = 0")
    stepwise = counts.apply_deltas(counts.apply_deltas(empty, counts.message_deltas(half)), counts.message_deltas(archive.messages.filter("id % 2 = 1")))
    columns = ("peer_external_id", *[c for c in deltas.columns if c in COUNT_COLUMNS])
    assert rows(stepwise, *columns) == rows(archive.peer_counts, *columns)


def test_streams_do_not_depend_on_batches(spark, archive, tmp_path):
    """Shuffled and repeated deliveries, replayed batches included, leave the batch result."""
    first = core(archive.messages).withColumn("seq", F.col("id"))
    again = core(redelivered_messages(message_base(archive.source))).withColumn("seq", F.col("id"))
    everything = first.unionByName(again)
    mixed = everything.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    parts = [mixed.filter(F.pmod(F.xxhash64("id", "seq", "copy"), F.lit(3)) == i).drop("copy") for i in range(3)]
    store = jobs.MessageStream(spark, str(tmp_path / "m"))
    counters = jobs.CounterStream(spark, str(tmp_path / "c"))
    edges = jobs.ForwardStream(spark, str(tmp_path / "f"))
    for i, part in enumerate([parts[0], parts[1], parts[1], parts[2]]):
        batch = [0, 1, 1, 2][i]
        store.on_batch(part, batch)
        edges.on_batch(part, batch)
        counters.on_batch(part, batch)
    assert counters.counters().agg(F.sum("posts")).first()[0] == everything.select("peer_external_id", "telegram_message_id").distinct().count()
    assert rows(edges.edges()) == rows(jobs.forward_edges(jobs.forward_occurrences(everything)))
    once = core(merge.merge_messages(spark.createDataFrame([], MESSAGES), everything, "seq", strict_kind=False))
    merged = core(merge.merge_messages(spark.createDataFrame([], MESSAGES), store.log.all().drop("batch_id"), "seq", strict_kind=False))
    # repeats of a delivery may clear media under the strict rule, never under the other
    assert rows(merged) == rows(once)
    assert rows(core(store.merged(spark.createDataFrame([], MESSAGES))).drop("media")) == rows(once.drop("media"))


def test_streams_over_a_compaction(spark, archive, tmp_path):
    """Compacting between batches, and running the newest batch again after it, changes nothing; old folders go."""
    everything = core(archive.messages).withColumn("seq", F.col("id"))
    parts = [everything.filter(F.pmod(F.xxhash64("id"), F.lit(4)) <= i) for i in range(4)]
    counters = jobs.CounterStream(spark, str(tmp_path / "c"), buckets=8)
    edges = jobs.ForwardStream(spark, str(tmp_path / "f"), buckets=8)
    spans = jobs.CoverageStream(spark, str(tmp_path / "s"))
    store = jobs.MessageStream(spark, str(tmp_path / "m"))
    for i, part in enumerate(parts):
        for stream in (counters, edges, spans, store):
            stream.on_batch(part, i)
            if i == 2:
                if stream is not store:
                    stream.compact()
                stream.on_batch(part, i)
    assert rows(jobs.CounterStream(spark, str(tmp_path / "c")).counters()) == rows(counters.counters())
    assert counters.counters().agg(F.sum("posts")).first()[0] == everything.count()
    assert rows(edges.edges()) == rows(jobs.forward_edges(jobs.forward_occurrences(everything)))
    whole = everything.groupBy("peer_external_id").agg(F.min("date").alias("covered_after"), F.max("date").alias("covered_before"))
    assert rows(spans.coverage()) == rows(whole)
    folders = lambda log: sorted({r[0] for r in log.all().select("batch_id").distinct().collect()})
    assert folders(counters.keys) == folders(edges.log) == [1, 2, 3]
    base = store.compact(archive.messages.filter("id % 2 = 0"), str(tmp_path / "base"))
    assert rows(core(store.merged(base)).drop("media")) == rows(everything.drop("seq", "media"))
    plan = counters.keys.before(3, [1, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_increment_over_all_peers_equals_rebuild(archive):
    args = (archive.image_embeddings, archive.scope_inputs, archive.image_blob_messages, archive.forward_edge_messages, archive.peers)
    p = ScopeParams(tau=0.05)
    empty = scope.rerank(args[0], args[1].limit(0), *args[2:], p)
    built = scope.rerank(*args, p)
    grown = scope.score_increment(*args, empty, archive.peer_counts.select("peer_external_id"), p)
    assert rows(grown["evidence"]) == rows(built["evidence"])
    assert rows(grown["events"]) == rows(built["events"])
    again = scope.score_increment(*args, grown, archive.peer_counts.select("peer_external_id"), p)
    assert again["fresh_evidence"].isEmpty() and again["fresh_events"].isEmpty()
    a = {r["peer_external_id"]: r["forward_score"] for r in grown["peers"].collect()}
    b = {r["peer_external_id"]: r["forward_score"] for r in built["peers"].collect()}
    assert a == pytest.approx(b)


def brute_force(vectors_, asked, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors_.items() if np.any(v)}
    best = {}
    for q, v in asked.items():
        ranked = sorted(((-float(u @ (np.array(v) / np.linalg.norm(v))), i) for i, u in unit.items()))
        best[q] = [i for _, i in ranked[:k]]
    return best


def test_nearest_equals_brute_force_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = {i: rng.normal(size=6).tolist() for i in range(200)}
    data[7] = [0.0] * 6
    data[9] = data[8]
    asked = {100 + i: rng.normal(size=6).tolist() for i in range(7)}
    vectors_ = spark.createDataFrame(list(data.items()), "phash bigint, embedding array<float>").repartition(4)
    questions = spark.createDataFrame(list(asked.items()), "query_id bigint, embedding array<float>")
    expected = brute_force(data, asked, 5)
    for block in (1024, 3):
        monkeypatch.setattr(knn, "BLOCK", block)
        monkeypatch.setattr(knn.query_blocks, "__defaults__", (block,))
        found = {}
        for r in knn.nearest(vectors_, questions, 5, "phash").orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["phash"])
        assert found == expected
        best = {r["phash"]: r["s"] for r in knn.best_match(vectors_, questions.withColumnRenamed("query_id", "id"), "phash").collect()}
        assert len(best) == 199
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        assert best[3] == pytest.approx(max(float(unit(data[3]) @ unit(v)) for v in asked.values()), abs=1e-6)


def test_vectors_of_different_widths_compare_as_if_padded(spark):
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [])], "phash bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 2.0, 0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [(r["phash"], round(r["score"], 6)) for r in knn.nearest(vectors_, asked, 5, "phash").orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]


def test_a_hot_peer_and_a_hot_image(spark):
    """A third of all messages in one channel, all showing one image, forwarded from one post."""
    n = 30_000
    base = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, -1000000000001).otherwise(-1000000000001 - F.col("id") % 1000).alias("peer_external_id"),
        (F.col("id") + 1).alias("telegram_message_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("date"),
    )
    from channelgraph.operators import graph, images

    links = base.select(
        F.when(F.col("id") % 3 == 0, "aaaaaaaaaaaaaaaa").otherwise(F.lpad(F.hex(F.col("id") % 500), 16, "1")).alias("phash"),
        F.col("id").alias("message_id"), F.col("date").alias("message_date"), "peer_external_id", "telegram_message_id",
    )
    blobs = links.select("phash", F.lit(None).cast("string").alias("canonical_path"), F.lit(0).alias("refcount")).distinct()
    hot = images.image_rollup(blobs, links).filter("phash = 'aaaaaaaaaaaaaaaa'").first()
    assert (hot["appearances"], hot["unique_peers"]) == (n // 3, 1)
    fwd = "struct<from_id:struct<_:string,tl:string,channel_id:string,chat_id:string,user_id:string>,saved_from_peer:struct<_:string,tl:string,channel_id:string,chat_id:string,user_id:string>,channel_post:string,saved_from_msg_id:string,from_name:string>"
    header = F.from_json(F.lit('{"from_id":{"_":"PeerChannel","channel_id":"77777"},"channel_post":"5"}'), fwd)
    forwards = base.withColumns({"excerpt": F.lit("x"), "media_kind": F.lit(None).cast("string"), "fwd_from": header})
    nodes, edges = graph.message_layer(forwards, spark.createDataFrame([], MESSAGES))
    assert nodes.count() == 1 and nodes.first()["message_id"] == n - 1
    assert edges.filter("kind = 'forwarded_from'").count() == base.select("peer_external_id").distinct().count()


def test_unbounded_expansion_reaches_everything(archive):
    edges = {}
    for r in archive.forward_edges.collect():
        edges.setdefault(r["from_external_id"], set()).add(r["to_external_id"])
    seed = min(edges)
    depth, frontier, seen = 0, {seed}, {seed: 0}
    while frontier:
        depth += 1
        frontier = {t for f in frontier for t in edges.get(f, ()) if t not in seen}
        seen.update(dict.fromkeys(frontier, depth))
    start = archive.spark.createDataFrame([(seed,)], "peer_id bigint")
    walked = {r["peer_id"]: r["depth"] for r in expand.expand(archive.forward_edges, start).collect()}
    assert walked == seen


def test_encoding_is_deterministic_and_skips_empty(spark):
    df = spark.createDataFrame([("a", b"xyz"), ("b", b""), ("c", None), ("d", b"xyz")], "phash string, content binary")
    got = {r["phash"]: tuple(r["embedding"]) for r in encode.embed_images(df, encode.HashingEncoder, "m").collect()}
    assert set(got) == {"a", "d"} and got["a"] == got["d"]
    assert tuple(encode.embed_progress(df).first()) == (2, 2)
    assert encode.prefix_texts("multilingual-e5-small", ["x"], True) == ["query: x"]
    assert encode.prefix_texts("bge-small-en-v1.5", ["x"], False) == ["x"]


def ppm(path, pixels):
    """A small uncompressed bitmap that the image source can decode."""
    h, w, _ = pixels.shape
    pad = (4 - w * 3 % 4) % 4
    body = b"".join(pixels[y].astype(np.uint8).tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\0" * 24
    path.write_bytes(head + info + body)


def test_image_hashes(spark, tmp_path):
    y, x = np.mgrid[0:48, 0:64]
    wave = np.stack([128 + 100 * np.sin(x / 9) * np.cos(y / 7)] * 3, axis=2)
    ppm(tmp_path / "a.bmp", wave)
    ppm(tmp_path / "b.bmp", wave)
    ppm(tmp_path / "c.bmp", np.clip(wave + 3, 0, 255))
    ppm(tmp_path / "d.bmp", 255 - wave)
    (tmp_path / "broken.bmp").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r["phash"] for r in encode.hash_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.bmp", "b.bmp", "c.bmp", "d.bmp"}
    bits = lambda a, b: bin(int(got[a], 16) ^ int(got[b], 16)).count("1")
    assert got["a.bmp"] == got["b.bmp"] and bits("a.bmp", "c.bmp") <= 4 and bits("a.bmp", "d.bmp") > 20


def test_file_types(spark, tmp_path):
    for name, head in (("a.jpg", b"\xff\xd8\xff"), ("b.bin", b"RIFF0000WEBP"), ("c.mp4", b"\0\0\0\x18ftypisom"), ("d.txt", b"hello")):
        (tmp_path / name).write_bytes(head)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["content_type"], r["suffix"]) for r in encode.classify_files(spark, str(tmp_path)).collect()}
    assert got == {
        "a.jpg": ("image", "image/jpeg", ".jpg"), "b.bin": ("image", "image/webp", ".webp"),
        "c.mp4": ("video", "video/mp4", ".jpg"), "d.txt": (None, None, ".jpg"),
    }


def test_message_export_is_written_in_order(spark, archive, tmp_path):
    flat = exports.export_messages(archive.messages, archive.peers, archive.image_blob_messages).drop("content")
    exports.save(flat, str(tmp_path / "out"), exports.message_export_order())
    seen = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        lines = part.read_text().splitlines()[1:]
        seen += [line.split(",")[0] for line in lines]
    assert len(seen) == archive.messages.count()
    expected = [str(r["id"]) for r in flat.orderBy(*exports.message_export_order()).select("id").collect()]
    assert seen == expected


def test_write_back_leaves_other_months_alone(spark, archive, tmp_path):
    """Only months that a delivery touches get new files, and the whole equals the merge."""
    import os

    path = str(tmp_path / "by-month")
    merge.write_by_month(archive.messages, path)

    def files():
        return {m: sorted(os.listdir(f"{path}/{m}")) for m in os.listdir(path) if m.startswith("month=")}

    before = files()
    month = sorted(before)[0].removeprefix("month=")
    delta = redelivered_messages(message_base(archive.source)).filter(F.date_format("date", "yyyy-MM") == month)
    want = core(merge.merge_messages(archive.messages, delta))
    touched = [r["month"] for r in merge.write_back(spark, path, delta).collect()]
    after = files()
    assert touched == [month] and all((before[m] == after[m]) == (m != f"month={month}") for m in before)
    assert rows(core(spark.read.parquet(path))) == rows(want)


@pytest.mark.parametrize("block", [1024, 2])
def test_whole_searches_ask_every_hundredth_vector(spark, archive, monkeypatch, block):
    monkeypatch.setattr(knn.query_blocks, "__defaults__", (block,))
    asked = {r[0] for r in archive.source.embeddings.filter("vec_id % 100 = 0").select("vec_id").collect()}
    for name in ("v1_knn_messages_whole", "v2_knn_images_whole"):
        found = [r["query_id"] for r in QUERIES[name](archive).select("query_id").collect()]
        assert set(found) == asked and len(found) == 20 * len(asked) and len(asked) > 2


def test_the_whole_peer_export_has_all_columns_filled(archive):
    out = QUERIES["x1_export_peers_whole"](archive)
    assert out.columns == exports.PEER_COLUMNS and len(out.columns) == 63
    filled = out.agg(*[F.count_distinct(c).alias(c) for c in out.columns]).first().asDict()
    assert [c for c, n in filled.items() if n < 1] == []
