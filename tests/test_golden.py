"""Small literal cases for the column rules and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from channelgraph.functions import forwards as fwd
from channelgraph.functions import ids, media, predicates, scores, text, timecov, vectors
from channelgraph.operators import coverage, expand, graph, images, knn, layers, listing, merge
from channelgraph.operators import forwards as forward_ops
from channelgraph.plans import exports
from channelgraph.schemas import FWD_FROM, MEDIA, MESSAGES, PEERS, TABLES
from channelgraph.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day(text_):
    return dt.datetime.fromisoformat(text_)


def media_struct(json):
    return F.from_json(F.lit(json), MEDIA)


def fwd_struct(json):
    return F.from_json(F.lit(json), FWD_FROM)


@pytest.mark.parametrize(
    ("json", "kind"),
    [
        ('{"kind":"document","mime_type":"image/jpeg"}', "image"),
        ('{"kind":"document","mime_type":"image/png","file_name":"x.png"}', "image"),
        ('{"kind":"document","mime_type":"video/mp4"}', "video"),
        ('{"kind":"document","mime_type":"application/pdf","file_name":"a.pdf"}', "document"),
        ('{"kind":"document","file_name":"photo.HEIC"}', "image"),
        ('{"tl":"MessageMediaPhoto"}', "image"),
        ('{"kind":"video","mime_type":"image/png"}', "video"),
        ('{"tl":"MessageMediaWebPage"}', None),
        ('{"kind":"document","mime_type":"image/svg+xml"}', "document"),
        ('{"file_name":"clip.mp4\\n"}', None),
    ],
)
def test_media_kind(spark, json, kind):
    assert one(spark, media.media_kind(media_struct(json))) == kind


def test_media_kind_modes_differ_where_stated(spark):
    blank_mime = media_struct('{"mime_type":" image/png"}')
    assert one(spark, media.media_kind(blank_mime)) is None
    assert one(spark, media.media_kind_by_hints(blank_mime)) == "image"
    photo = media_struct('{"tl":"MessageMediaPhoto","mime_type":"application/x"}')
    assert one(spark, media.media_kind(photo)) == "image"
    assert one(spark, media.media_kind_by_hints(photo)) == "document"


@pytest.mark.parametrize(
    ("raw", "inferred", "target"), [(-1001293233260, "channel", True), (-12345, "chat", True), (42, "user", False)]
)
def test_ids(spark, raw, inferred, target):
    c = F.lit(raw).cast("bigint")
    assert one(spark, ids.infer_type(c)) == inferred
    assert one(spark, ids.is_target(c)) is target
    assert one(spark, ids.signed_channel(F.lit(1293233260))) == -1001293233260


@pytest.mark.parametrize(
    ("json", "origin"),
    [
        ('{"from_id":{"_":"PeerChannel","channel_id":99}}', -1000000000099),
        ('{"saved_from_peer":{"_":"PeerChat","chat_id":5}}', -5),
        ('{"from_id":{"tl":"PeerUser","user_id":"7"}}', 7),
        ('{"from_id":{"_":"PeerUser"},"saved_from_peer":{"_":"InputPeerChannel","channel_id":3}}', -1000000000003),
        ('{"from_name":"x"}', None),
        ('{"from_id":{"_":"PeerChannel","channel_id":"abc"}}', None),
    ],
)
def test_forward_origin(spark, json, origin):
    assert one(spark, fwd.fwd_origin(fwd_struct(json))) == origin


def test_origin_matches_either_header_but_only_exact_tags(spark):
    both = fwd_struct('{"from_id":{"_":"PeerUser","user_id":4},"saved_from_peer":{"_":"PeerChannel","channel_id":3}}')
    assert one(spark, fwd.fwd_origin(both)) == 4
    assert one(spark, fwd.origin_matches(both, -1000000000003))
    loose = fwd_struct('{"from_id":{"_":"InputPeerChannel","channel_id":3}}')
    assert not one(spark, fwd.origin_matches(loose, -1000000000003))


@pytest.mark.parametrize(
    ("json", "post"),
    [('{"channel_post":88}', 88), ('{"channel_post":0,"saved_from_msg_id":12}', 12), ('{"channel_post":"0"}', None)],
)
def test_origin_post(spark, json, post):
    assert one(spark, fwd.fwd_origin_msg(fwd_struct(json))) == post


@pytest.mark.parametrize(
    ("raw", "normal", "usable"),
    [
        (" ABCDEF0123456789 ", "abcdef0123456789", True), ("abc", None, False), ("zzzzzzzzzzzzzzzz", None, False),
        ("0000000000000000", "0000000000000000", False), (None, None, False), ("abcdef0123456789\n\nx", None, False),
    ],
)
def test_phash(spark, raw, normal, usable):
    assert one(spark, text.norm_phash(F.lit(raw).cast("string"))) == normal
    assert one(spark, text.is_dedupable(F.lit(raw).cast("string"))) is usable


@pytest.mark.parametrize(
    ("size", "label"),
    [(0, "0 B"), (512, "512 B"), (1024, "1 KB"), (1536, "1.5 KB"), (12582912, "12 MB"), (2**30, "1 GB"), (None, None),
     (-1, None), (2**50, "1024 TB"), (10239, "10 KB")],
)
def test_byte_labels(spark, size, label):
    got = one(spark, media.format_bytes(F.lit(size).cast("bigint")))
    # 10239 bytes are below ten kilobytes, where one decimal is kept and dropped if zero
    assert got == label


@pytest.mark.parametrize(
    ("item", "parsed"),
    [("12", ("document", "12")), ("msg:12", ("message", "12")),
     ("MSG:0B9F0E4C-0000-4000-8000-000000000000", ("message", "0b9f0e4c-0000-4000-8000-000000000000")), ("x", None)],
)
def test_parse_item_id(spark, item, parsed):
    row = one(spark, media.parse_item_id(F.lit(item)))
    assert (tuple(row) if row else None) == parsed


@pytest.mark.parametrize(
    ("after", "share"), [("2025-06-01", 0.5), ("2024-06-01", 1.0), (None, 0.0), ("2020-01-01", 1.0), ("2030-01-01", 0.0)]
)
def test_coverage_ratio(spark, after, share):
    ratio = timecov.coverage_ratio(
        timecov.bound("2024-06-01"), timecov.bound("2026-06-01"), F.lit(after).cast("timestamp_ntz")
    )
    assert one(spark, ratio) == pytest.approx(share)


def test_coverage_ratio_of_an_empty_span_is_full(spark):
    at = timecov.bound("2024-06-01")
    assert one(spark, timecov.coverage_ratio(at, at, at)) == 1.0


def test_relevance_mix_and_forward_score(spark):
    p = scores.ScopeParams()
    for s, r in ((0.4, 0.0), (0.7, 0.25), (1.0, 1.0)):
        assert one(spark, scores.relevance(F.lit(s), p)) == pytest.approx(r)
    assert one(spark, scores.relevance(F.lit(1.5), scores.ScopeParams(tau=1.0))) == 1.0
    assert one(spark, scores.mix(F.lit(1.0), F.lit(4), p)) == pytest.approx(1 / 3.6)
    assert one(spark, scores.mix(F.lit(0.0), F.lit(0), scores.ScopeParams(alpha=0.0))) == 0.0
    assert one(spark, scores.forward_score(F.lit(0.0), F.lit(3), p)) == pytest.approx(0.05 * 1.3862943611)
    assert scores.ScopeParams.from_row({"tau": 0, "gamma": 3}) == scores.ScopeParams(gamma=3.0)


def test_vectors(spark):
    def floats(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    assert one(spark, vectors.dot(vectors.unit(floats(3, 4)), vectors.unit(floats(6, 8)))) == pytest.approx(1.0)
    assert one(spark, vectors.unit(vectors.parse_vector(F.lit("[3.0,4.0,0.0]")))) == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, vectors.unit(floats(0, 0))) is None
    assert one(spark, vectors.unit(F.array().cast("array<float>"))) is None
    assert len(one(spark, vectors.unit(F.array_repeat(F.lit(1.0), 1281)))) == 1281
    assert len(one(spark, vectors.unit(F.array_repeat(F.lit(1.0), 1152)))) == 1152


def test_media_parameter():
    assert predicates.parse_media(None) is None
    assert predicates.parse_media("") == frozenset()
    assert predicates.parse_media("bogus") is None
    assert predicates.parse_media("none,image,video,audio,gif,document") is None
    assert predicates.parse_media(" image , none") == {"image", "none"}


def test_handles_and_restrictions(spark):
    handles = F.from_json(
        F.lit('[{"username":"alt","active":false},{"username":"NEWS"},{"username":"@alt"}]'),
        "array<struct<username:string,active:boolean,editable:boolean>>",
    )
    got = one(spark, text.usernames(F.lit("@news"), handles))
    assert [(h["username"], h["active"]) for h in got] == [("NEWS", True), ("alt", False)]
    assert one(spark, text.usernames_csv(handles)) == "alt;NEWS"
    reasons = F.from_json(
        F.lit('[{"platform":"ios","reason":"porn","text":"blocked"}]'),
        "array<struct<platform:string,reason:string,text:string>>",
    )
    assert one(spark, text.restriction_csv(reasons)) == "ios:porn: blocked"
    assert one(spark, text.usernames_csv(F.lit(None).cast(TABLES["peers"]["usernames"].dataType))) == ""


@pytest.mark.parametrize(
    ("nodes", "edges", "size", "band"),
    [(10, 10, 10, "auto"), (25001, 0, 0, "confirm"), (0, 80001, 0, "confirm"), (80001, 0, 0, "block"),
     (0, 0, 80 * 1024**2 + 1, "block"), (25000, 80000, 25 * 1024**2, "auto")],
)
def test_budget_band(spark, nodes, edges, size, band):
    assert one(spark, graph.budget_band(F.lit(nodes), F.lit(edges), F.lit(size))) == band


# ---- message layer

FORWARD = "id bigint, peer_external_id bigint, telegram_message_id bigint, date timestamp_ntz, excerpt string, media_kind string, channel bigint, post int"


def forwards(spark, rows):
    df = spark.createDataFrame(rows, FORWARD)
    header = F.concat(
        F.lit('{"from_id":{"_":"PeerChannel","channel_id":'), "channel", F.lit("}"),
        F.coalesce(F.concat(F.lit(',"channel_post":'), "post"), F.lit("")), F.lit("}"),
    )
    return df.withColumn("fwd_from", F.from_json(header, FWD_FROM)).drop("channel", "post")


def messages(spark, rows=()):
    names = ("id", "peer_external_id", "telegram_message_id", "date", "content")
    full = [{**dict.fromkeys(MESSAGES.fieldNames()), **dict(zip(names, r))} for r in rows]
    return spark.createDataFrame(full, MESSAGES)


def test_message_layer_stub(spark):
    nodes, edges = graph.message_layer(forwards(spark, [(1, -100, 7, day("2024-01-01"), "hi", None, 99, 44)]), messages(spark))
    node = nodes.first()
    assert (node["id"], node["stub"], node["message_id"], node["label"]) == ("m:orig:-1000000000099:44", True, 1, "hi")
    assert {tuple(e) for e in edges.collect()} == {
        ("m:orig:-1000000000099:44", "-1000000000099", "sent_to", 1),
        ("-100", "m:orig:-1000000000099:44", "forwarded_from", 1),
    }


def test_message_layer_uses_stored_original(spark):
    stored = messages(spark, [(50, -1000000000005, 3, day("2023-05-05"), " the original ")])
    nodes, _ = graph.message_layer(forwards(spark, [(1, -100, 7, day("2024-01-01"), "copy", "gif", 5, 3)]), stored)
    node = nodes.first()
    assert (node["id"], node["stub"], node["label"], node["date"], node["media_kind"], node["message_id"]) == (
        "m:50", False, "the original", day("2023-05-05"), None, 50
    )


def test_message_layer_collapses_copies(spark):
    rows = [
        (1, -100, 7, day("2024-01-02"), "later copy", None, 9, 4),
        (2, -200, 8, day("2024-01-01"), None, "gif", 9, 4),
    ]
    nodes, edges = graph.message_layer(forwards(spark, rows), messages(spark))
    node = nodes.first()
    assert (node["date"], node["label"], node["media_kind"], node["message_id"]) == (day("2024-01-01"), "later copy", "gif", 2)
    assert edges.count() == 3


def test_message_layer_without_origin_post_is_empty(spark):
    nodes, edges = graph.message_layer(forwards(spark, [(1, -100, 7, day("2024-01-01"), "x", None, 9, None)]), messages(spark))
    assert nodes.count() == edges.count() == 0


def test_graphs_are_whole_and_tops_say_so(spark):
    header = fwd_struct('{"from_id":{"_":"PeerChannel","channel_id":9},"channel_post":4}')
    posted = spark.range(3).select(
        "id", F.lit(-100).cast("bigint").alias("peer_external_id"), F.col("id").alias("telegram_message_id"),
        timecov.bound("2024-01-01").alias("date"), F.lit("x").alias("content"), header.alias("fwd_from"),
        F.lit(None).cast(MEDIA).alias("media"),
    )
    assert graph.message_graph(posted)[0].count() == 1
    for n, more in ((1, True), (2, True), (3, False)):
        nodes, _, truncated = graph.newest_message_graph(posted, n)
        assert nodes.count() == 1 and [tuple(r) for r in truncated.collect()] == [(more,)]
    links = spark.createDataFrame(
        [(h, i, day("2024-01-01"), p, i) for i, (h, p) in enumerate([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1)])],
        TABLES["image_blob_messages"],
    )
    tables = links, peer_rows(spark), covered(spark, "peer_fetch_coverage")

    def shown(nodes):
        return {r["phash"] for r in nodes.collect()} - {None}

    assert shown(graph.shared_image_graph(*tables)[0]) == {"a", "b"}
    for n, kept, more in ((1, {"b"}, True), (2, {"a", "b"}, False)):
        nodes, _, truncated = graph.top_shared_image_graph(*tables, n)
        assert shown(nodes) == kept and truncated.first()["truncated"] == more
    assert shown(graph.top_shared_image_graph(*tables, 1, peer=1)[0]) == {"b"}


def test_more_images_than_any_screen_shows(spark):
    """50 000 shared images give 50 000 nodes."""
    pairs = spark.range(100_000).select(
        F.format_string("%016x", F.floor(F.col("id") / 2) + 1).alias("phash"), F.col("id").alias("message_id"),
        timecov.bound("2024-01-01").alias("message_date"), (F.col("id") % 2 + 1).alias("peer_external_id"), F.col("id").alias("telegram_message_id"),
    )
    nodes, edges = graph.shared_image_graph(pairs, peer_rows(spark), covered(spark, "peer_fetch_coverage"))
    assert nodes.filter("kind = 'image'").count() == 50_000 and edges.count() == 100_000


def test_vectors_of_any_width_are_found(spark):
    wide = [(i, [0.0] * (1279 + i) + [1.0]) for i in range(3)] + [(9, [1.0])]
    vectors = spark.createDataFrame(wide, "message_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.0] * 1280 + [2.0])], "query_id long, embedding array<float>")
    hits = [tuple(r)[1:3] for r in knn.nearest(vectors, asked, 4, "message_id").orderBy("rank").collect()]
    assert hits[0] == (1, 1.0) and len(hits) == 4


def test_several_blocks_of_questions(spark, monkeypatch):
    """Blocks of two: the same hits, and no more than one broadcast held at a time."""
    vectors_ = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "message_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(7)], "query_id long, embedding array<float>")

    def found(df):
        return sorted(tuple(round(x, 9) for x in r) for r in df.collect())

    whole = found(knn.nearest(vectors_, asked, 3, "message_id"))
    best = found(knn.best_match(vectors_, asked, "message_id", "query_id"))
    plain = knn.query_blocks
    live, most = set(), []
    send = type(spark.sparkContext).broadcast

    def sent(self, value):
        shared = send(self, value)
        live.add(id(shared))
        most.append(len(live))
        give_back = shared.unpersist
        shared.unpersist = lambda: (live.discard(id(shared)), give_back())
        return shared

    monkeypatch.setattr(knn, "query_blocks", lambda q, key: plain(q, key, 2))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sent)
    assert found(knn.nearest(vectors_, asked, 3, "message_id")) == whole and max(most) == 1
    assert found(knn.best_match(vectors_, asked, "message_id", "query_id")) == best and max(most) == 1


def test_names_of_merged_edges_are_those_of_one_build(spark):
    rows = [(1, -1, -2, "A", day("2024-01-01")), (2, -1, -2, "B", day("2024-01-03")), (3, -1, -2, None, day("2024-01-09")), (4, -1, -2, "C", day("2024-01-02"))]
    occ = spark.createDataFrame(rows, "message_id long, from_external_id long, to_external_id long, from_name string, message_date timestamp_ntz")
    whole = forward_ops.forward_edges(occ, keep_named=True).collect()
    for cut in (1, 2, 3):
        halves = [forward_ops.forward_edges(occ.filter(f), keep_named=True) for f in (f"message_id <= {cut}", f"message_id > {cut}")]
        for a, b in (halves, halves[::-1]):
            assert forward_ops.merge_edges(a, b).select(*whole[0].asDict()).collect() == whole
    assert whole[0]["last_from_name"] == "B"


def partial_below_peer_shuffle(df):
    """Whether rows are aggregated before they are dealt out by peer alone."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    last = [line for line in plan.splitlines() if "hashpartitioning(peer_external_id" in line][0]
    after = plan[plan.index(last) + len(last) :].splitlines()
    return "part" in last.split("hashpartitioning")[1].split(")")[0] or "HashAggregate" in after[1] and "partial_" in after[1]


def test_busy_peers_are_split(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame(
            [(1, 5, day("2024-01-01")), (1, 6, day("2024-01-02")), (2, 7, day("2024-01-03"))], "peer_external_id long, telegram_message_id long, date timestamp_ntz"
        )
        peers = spark.createDataFrame([(1, 5), (2, 7)], "external_id long, first_message_id long")
        spans = coverage.id_span(rows, peers)
        assert [tuple(r) for r in spans.collect()] == [(1, 6, 6)] and partial_below_peer_shuffle(spans)
        floor = spark.createDataFrame([(1, 6)], "peer_external_id long, min_id long")
        covered_ = coverage.fetch_coverage(rows, floor)
        assert {r[0]: r[1] for r in covered_.collect()} == {1: day("2024-01-02"), 2: day("2024-01-03")} and partial_below_peer_shuffle(covered_)
        fetched = spark.createDataFrame([(9,)], "peer_external_id long")
        left = merge.purge_probe_only(rows, peers, fetched)
        assert {tuple(r)[:2] for r in left.collect()} == {(1, 5), (1, 6)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_executors_get_the_package(tmp_path):
    """Vector search from another folder, where workers do not find the package by chance."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        import __spark_entry__ as e
        from channelgraph.session import local_session
        spark = local_session(4)
        assert e.queries()["v1_knn_messages"](spark, "/root/testdata/sf0.001").count() > 0
        print("found", "neighbours")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "found neighbours" in done.stdout, done.stderr[-2000:]


# ---- layers

def small_graph(spark):
    nodes = [
        ("1", "peer", True, None), ("2", "peer", False, None), ("m:1", "message", True, "image"),
        ("m:2", "message", True, None), ("img:a", "image", True, "image"), ("img:b", "image", True, "image"),
    ]
    edges = [
        ("1", "2", "forward_from", 3), ("m:1", "2", "sent_to", 1), ("1", "m:1", "forwarded_from", 1),
        ("m:2", "1", "sent_to", 1), ("1", "m:2", "forwarded_from", 1), ("img:a", "1", "appeared_in", 2),
    ]
    n = spark.createDataFrame(nodes, "id string, kind string, scraped boolean, media_kind string").withColumn("is_scraping", F.lit(False))
    return n, spark.createDataFrame(edges, "source string, target string, kind string, count bigint")


def shown(result):
    return {r["id"] for r in result[0].collect()}, {tuple(r)[:3] for r in result[1].select("source", "target", "kind").collect()}


def test_layers(spark):
    g = small_graph(spark)
    assert shown(layers.filter_graph(*g)) == ({"1", "2"}, {("1", "2", "forward_from")})
    # m:2 was forwarded only by the peer it came from
    assert {r["id"] for r in layers.self_forwards(g[1]).collect()} == {"m:2"}
    ids_, lines = shown(layers.filter_graph(*g, layers.Layers(forward_messages=True, shared_images=True, forward_to=True)))
    assert ids_ == {"1", "2", "m:1", "img:a"}
    assert ("2", "1", "forward_to") in lines
    assert "m:2" in shown(layers.filter_graph(*g, layers.Layers(forward_messages=True, self_forwards=True)))[0]
    # hiding one end takes the message with it
    assert shown(layers.filter_graph(*g, layers.Layers(forward_messages=True, unscraped_peers=False)))[0] == {"1"}
    assert shown(layers.filter_graph(*g, layers.PRESETS["shared-images"]))[0] == {"1", "2", "img:a"}


def test_layers_are_idempotent_and_fingerprint_ignores_order(spark):
    once = layers.filter_graph(*small_graph(spark))
    assert shown(layers.filter_graph(*once)) == shown(once)
    nodes, edges = small_graph(spark)
    full = nodes.withColumns({"degree": F.lit(1), "forward_volume": F.lit(1)})
    a = layers.graph_fingerprint(full, edges).first()
    assert a == layers.graph_fingerprint(full.orderBy(F.desc("id")).repartition(3), edges.repartition(2)).first()
    assert a != layers.graph_fingerprint(full, edges.withColumn("count", F.col("count") + 1)).first()


# ---- peers

def peer_rows(spark, *rows):
    full = [{**dict.fromkeys(PEERS.fieldNames()), **r} for r in rows]
    return spark.createDataFrame(full, PEERS)


def counts_rows(spark, *rows):
    schema = TABLES["peer_counts"]
    return spark.createDataFrame([{**dict.fromkeys(schema.fieldNames(), 0), **r} for r in rows], schema)


def covered(spark, table, *rows):
    schema = TABLES[table]
    return spark.createDataFrame([{**dict.fromkeys(schema.fieldNames()), **r} for r in rows], schema)


def test_peer_statistics(spark):
    peers = peer_rows(
        spark,
        {"external_id": 1, "messages_scraped": 24}, {"external_id": 2, "messages_scraped": 12}, {"external_id": 3},
        {"external_id": 4},
    )
    counts = counts_rows(
        spark,
        {"peer_external_id": 1, "posts": 24, "image_total": 3, "unique_forwards": 2, "total_forwards": 5},
        {"peer_external_id": 4, "posts": 10, "text_total": 10, "text_embedded": 4, "image_embeddable": 6, "image_embedded_unique": 2},
    )
    fetch = covered(spark, "peer_fetch_coverage", {"peer_external_id": 4})
    media_ = covered(spark, "peer_media_coverage", {"peer_external_id": 4, "videos_excluded": True, "large_excluded": False, "max_media_bytes": 0})
    rows = {r["external_id"]: r for r in listing.attach_stats(peers, counts, fetch, media_).collect()}
    assert (rows[1]["posts"], tuple(rows[1]["media"]["image"]), rows[1]["forwards_total"]) == (24, (3, 0, 0, 0), 5)
    assert (rows[2]["posts"], rows[2]["media"]["image"], rows[2]["forwards_total"]) == (12, None, None)
    assert (rows[3]["posts"], rows[3]["embed_text"]) == (None, None)
    assert tuple(rows[4]["embed_text"]) == (4, 10) and tuple(rows[4]["embed_images"]) == (2, 6)
    assert rows[4]["max_media_bytes"] is None and rows[4]["videos_excluded"]
    assert tuple(rows[4]["media"]["video"]) == (0, 0)


def test_flat_peer_row(spark):
    handles = [{"username": "news", "active": True, "editable": None}, {"username": "old", "active": False, "editable": None}]
    peers = peer_rows(spark, {"external_id": 1, "peer_type": "channel", "usernames": handles, "verified": False})
    counts = counts_rows(spark, {"peer_external_id": 1, "posts": 4, "image_unique": 10, "image_persisted": 2})
    none = covered(spark, "peer_fetch_coverage"), covered(spark, "peer_media_coverage")
    flat = exports.export_peers(peers, counts, *none)
    assert flat.columns == exports.PEER_COLUMNS and len(flat.columns) == 63
    row = flat.first()
    assert (row["usernames"], row["images_unique"], row["images_persisted"], row["videos_total"]) == ("news;old", 10, 2, None)
    assert len(exports.MESSAGE_COLUMNS) == 24
    assert exports.peer_types(["bot", "x"]) == ["bot"] and len(exports.peer_types(["x"])) == 5


def test_resolve_peer(spark):
    peers = peer_rows(
        spark,
        {"external_id": 1, "username": "Alpha", "usernames": [{"username": "beta", "active": True, "editable": None}]},
        {"external_id": 2, "username": "BETA"},
    )
    for asked, found in (("2", 2), ("@alpha", 1), ("beta", 2), ("nobody", None), ("77", None)):
        row = listing.resolve_peer(peers, asked).first()
        assert (row["external_id"] if row else None) == found


def test_csv_text(spark, tmp_path):
    df = spark.createDataFrame(
        [(None, True, day("2024-01-02T03:04:05.5"), 'a "b", c', [1, 2]), ("x", False, day("2024-01-02"), " y\nz", None)],
        "a string, b boolean, c timestamp_ntz, d string, e array<int>",
    ).coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"), ["a", "b", "c", "d", "e"])
    written = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert written == (
        'a,b,c,d,e\n,true,2024-01-02T03:04:05.500000+00:00,"a ""b"", c","[1,2]"\n'
        'x,false,2024-01-02T00:00:00+00:00," y\nz",\n'
    )


# ---- merges and walks

def test_merge_fills_gaps_and_keeps_old_media(spark):
    def message(id_, content, json):
        row = (id_, -5, 1, day("2024-01-01"), content, None, None, json, False, False)
        names = MESSAGES.fieldNames()
        df = spark.createDataFrame([row], ", ".join(f"{n} {'string' if n in ('fwd_from', 'media', 'content') else MESSAGES[n].dataType.simpleString()}" for n in names))
        return df.withColumns({"media": F.from_json("media", MEDIA), "fwd_from": F.from_json("fwd_from", FWD_FROM)})

    base = message(1, "old", '{"kind":"document","size_bytes":5,"downloaded":true}')
    delta = message(2, None, '{"kind":"video","size_bytes":9,"mime_type":"video/mp4"}')
    row = merge.merge_messages(base, delta).first()
    assert (row["id"], row["content"], row["inserted"]) == (1, None, False)
    m = row["media"]
    assert (m["kind"], m["size_bytes"], m["mime_type"], m["downloaded"]) == ("video", "5", "video/mp4", "true")
    plain = message(3, "x", '{"mime_type":"video/mp4"}')
    kindless = message(4, "y", '{"size_bytes":5}')
    assert merge.merge_messages(kindless, plain).first()["media"] is None
    assert merge.merge_messages(kindless, plain, strict_kind=False).first()["media"]["mime_type"] == "video/mp4"


def test_expand_depths_and_discoverers(spark):
    edges = spark.createDataFrame(
        [(-1, -2), (-1, -3), (-2, -4), (-3, -4), (-4, -1), (-4, 9), (-5, -6)], "from_external_id bigint, to_external_id bigint"
    )
    seeds = spark.createDataFrame([(-1,)], "peer_id bigint")
    walk = lambda d: {tuple(r) for r in expand.expand(edges, seeds, d).select("peer_id", "via", "depth").collect()}
    full = {(-1, None, 0), (-2, -1, 1), (-3, -1, 1), (-4, -3, 2)}
    assert walk(None) == full
    assert walk(0) == {(-1, None, 0)}
    assert walk(1) == {r for r in full if r[2] <= 1}


def test_frontier_order(spark):
    frontier = spark.createDataFrame(
        [(-1, 1, False, 1), (-2, 1, False, 2), (-3, 0, False, 3), (-4, 2, True, 4), (-5, 1, False, 5)],
        "peer_id bigint, depth int, retry boolean, seq int",
    )
    peers = peer_rows(spark, {"external_id": -2, "forward_score": 0.5}, {"external_id": -5, "forward_score": 0.5})
    scoped = [r["peer_id"] for r in expand.rank_frontier(frontier, peers, True, 5).collect()]
    assert scoped == [-4, -3, -2, -5, -1]
    assert [r["peer_id"] for r in expand.rank_frontier(frontier, peers, False, 3).collect()] == [-4, -3, -1]


def test_first_path_wins(spark):
    harvests = spark.createDataFrame(
        [("ABCDEF0123456789", None, 1), ("abcdef0123456789", "b", 3), ("abcdef0123456789", "a", 2), ("0" * 16, "z", 1)],
        "phash string, canonical_path string, seen_at int",
    )
    links = spark.createDataFrame([("abcdef0123456789", 1), ("abcdef0123456789", 2)], "phash string, message_id bigint")
    assert [tuple(r) for r in images.image_blobs(links, harvests).collect()] == [("abcdef0123456789", "a", 2)]
