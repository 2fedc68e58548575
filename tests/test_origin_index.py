"""The postings of origins and of short strings: the same rows as the filters they stand in for, read from fewer files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.functions import predicates
from channelgraph.functions.forwards import header_origins, origin_matches
from channelgraph.operators import merge, peer_search
from channelgraph.operators.origin_index import OriginIndex, postings
from channelgraph.schemas import FWD_FROM
from channelgraph.sources.derived import message_base, redelivered_messages

FIRST = "2024-01"
HEADERS = T.StructType([T.StructField("f", FWD_FROM)])


def stored_by_month(archive, path):
    """Every third message forty days later, so that there are several months."""
    late = F.col("date") + F.expr("INTERVAL 40 DAYS")
    merge.write_by_month(archive.messages.withColumn("date", F.when(F.col("id") % 3 == 0, late).otherwise(F.col("date"))), path)


def files(root):
    return {os.path.join(top, f) for top, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_scopes_equal_the_filter_for_every_kind_of_peer(spark, archive, tmp_path):
    stored_by_month(archive, str(tmp_path / "messages"))
    index = OriginIndex(spark, str(tmp_path / "messages"), str(tmp_path / "origins"))
    index.rebuild()
    messages = index.stored()
    busiest = index.table().groupBy("origin").count().orderBy(F.desc("count"))
    peers = [r["origin"] for r in busiest.limit(3).collect()]
    peers += [r["peer_external_id"] for r in messages.filter("peer_external_id > -1000000000000").select("peer_external_id").distinct().limit(3).collect()]
    for peer in [*peers, 999_999_999]:
        for window in ((None, None), ("2024-01-08", "2024-01-20"), (None, "2024-01-10"), ("2024-02-01", None)):
            for media in (None, {"none", "image"}):
                want = ids(messages.filter(predicates.message_scope(peer, *window, media)))
                assert ids(index.scope(peer, *window, media)) == want
    whole = index.whole(index.scope(peers[0]))
    assert ids(whole) == ids(messages.filter(predicates.message_scope(peers[0])))
    assert set(whole.columns) == set(messages.columns) - {"month"}
    many = index.scopes(spark.createDataFrame([(p,) for p in [*peers, peers[0], None]], "external_id long"))
    found = sorted((r["external_id"], r["id"]) for r in many.collect())
    assert found == sorted((p, i) for p in set(peers) for i in ids(index.scope(p)))


def test_only_months_of_the_window_and_of_a_delivery_are_touched(spark, archive, tmp_path):
    stored_by_month(archive, str(tmp_path / "messages"))
    index = OriginIndex(spark, str(tmp_path / "messages"), str(tmp_path / "origins"))
    index.rebuild()
    scope = index.scope(-1000000000001, "2024-01-01", "2024-01-31")
    plan = spark._jvm.PythonSQLUtils.explainString(scope._jdf.queryExecution(), "formatted")
    assert "EqualTo(origin,-1000000000001)" in plan and "EqualTo(peer_external_id,-1000000000001)" in plan
    assert len([line for line in plan.splitlines() if line.startswith("PartitionFilters:") and "2024-01" in line]) == 2
    assert "content" not in plan
    before = files(str(tmp_path / "origins"))
    delta = redelivered_messages(message_base(archive.source)).filter(merge.month_of() == FIRST).filter((F.col("id") - 10_000_000) % 3 != 0)
    assert index.write_back(delta) == [FIRST]
    after = files(str(tmp_path / "origins"))
    other = lambda names: {f for f in names if f"month={FIRST}" not in f}
    assert other(before) == other(after) and other(before) and before != after
    fresh = postings(index.stored())
    assert sorted(map(repr, index.table().select(*sorted(fresh.columns)).collect())) == sorted(map(repr, fresh.select(*sorted(fresh.columns)).collect()))


def test_a_month_without_postings_left_is_emptied(spark, archive, tmp_path):
    path = str(tmp_path / "messages")
    stored_by_month(archive, path)
    index = OriginIndex(spark, path, str(tmp_path / "origins"))
    index.rebuild()
    assert index.table().filter(F.col("month") == FIRST).count() > 0
    bare = archive.messages.withColumn("fwd_from", F.lit(None).cast(FWD_FROM)).filter(merge.month_of() == FIRST)
    merge.write_by_month(bare, path)
    index.refresh([FIRST])
    assert index.table().filter(F.col("month") == FIRST).count() == 0 < index.table().count()


def test_header_origins_are_what_origin_matches_finds(spark):
    def side(tag=None, tl=None, **ids):
        return {"_": tag, "tl": tl, **ids}

    sides = [
        None, side("PeerChannel", channel_id="7"), side(None, "PeerChat", chat_id="12"), side("PeerUser", user_id="5"), side("PeerUser", user_id="0"),
        side("PeerChannel", channel_id="x7"), side("PeerChannel", channel_id="0"), side("", "PeerChannel", channel_id="7"), side("MyPeerChannel", channel_id="7"),
        side("PeerChat", chat_id="1000000000000"), side("PeerChat", chat_id="1000000000007"), side("PeerChannel", channel_id="99999999999999999999"),
    ]
    rows = spark.createDataFrame([({"from_id": a, "saved_from_peer": b},) for a in sides for b in sides], HEADERS)
    peers = [-1000000000007, -12, 5, 0, -7, 7, -1000000000000, -1000000000014]
    tested = rows.select(header_origins(F.col("f")).alias("got"), *[origin_matches(F.col("f"), p).alias(str(p)) for p in peers])
    for r in tested.collect():
        assert len(r["got"]) == len(set(r["got"])) and None not in r["got"]
        assert {p for p in peers if r[str(p)]} == set(r["got"]) & set(peers)


PEERS = [
    (1, "Ärger & Co", "abc", "channel"), (2, None, None, "chat"), (-1000000000012, "abcabc", "", "megagroup"), (4, "", "Hän", None), (5, "ab c%d", "x_y", "bot"),
    (6, "a" * 5000 + "zz", None, "user"), (6, "twice", None, "user"),
]


def test_many_texts_find_what_single_searches_find(spark, archive, tmp_path):
    made = spark.createDataFrame(PEERS, "external_id long, title string, username string, peer_type string")
    for name, peers in (("made", made.dropDuplicates(["external_id"])), ("archive", archive.peers)):
        index = peer_search.PeerIndex(spark, str(tmp_path / name)).build(peers)
        texts = ["", " ", "@", "@@", "a", "AB", "abc", " @ABC ", "bcab", "abcabcabc", "ärg", "än", "c%d", "%", "_y", "x_", "chan", "hat", "12", "-1000", "zz"]
        texts += ["a" * 300 + "z", "Customer#0000001", "u12", "customer#000000012x", "er#", "group", "\t u1\n"]
        found = {}
        for r in index.search(spark.createDataFrame([(t,) for t in [*texts, texts[4], None]], "needle string")).collect():
            found.setdefault(r["needle"], []).append(r["external_id"])
        for text in texts:
            want = sorted(r[0] for r in peers.filter(predicates.peer_matches(text)).select("external_id").collect())
            assert sorted(found.get(text, [])) == want, text
        assert sorted(found[None]) == sorted(found[""])


def _rows_of_joins(plan):
    """The rows that the joins of a finished query gave out."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _rows_of_joins(plan.executedPlan())
    below = [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name and plan.metrics().contains("numOutputRows") else []
    return own + [n for child in below for n in _rows_of_joins(child)]


def test_many_texts_do_not_meet_all_peers_that_hold_their_pieces(spark, tmp_path):
    """All names are made of the same few pieces of three characters."""
    names = ["".join("ab"[i >> k & 1] for k in range(9)) for i in range(512)]
    peers = spark.createDataFrame([(i + 1, None, n, "user") for i, n in enumerate(names)], "external_id long, title string, username string, peer_type string")
    found = peer_search.PeerIndex(spark, str(tmp_path / "pieces")).build(peers).search(spark.createDataFrame([(n,) for n in names], "needle string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, i + 1) for i, n in enumerate(names))
    assert max(_rows_of_joins(found._jdf.queryExecution().executedPlan())) <= 6 * 512


def test_postings_are_cut_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(peer_search, "PEERS_A_TASK", 100, raising=False)
    made = spark.range(1, 1001).selectExpr("id AS external_id", "'Title ' || id AS title", "'u' || id AS username", "'user' AS peer_type")
    index = peer_search.PeerIndex(spark, str(tmp_path / "tasks")).build(made.coalesce(1))
    assert len(index.postings().inputFiles()) >= 10


def test_no_peers(spark, archive, tmp_path):
    index = peer_search.PeerIndex(spark, str(tmp_path / "none")).build(archive.peers.limit(0))
    assert index.search(spark.createDataFrame([("a",), ("",)], "needle string")).collect() == []
