"""References to shared texts hold no excerpt; graphs cut it from the texts for the nodes they end with."""

import pytest
from pyspark.sql import functions as F

from channelgraph.functions.text import EXCERPT_CHARS
from channelgraph.operators import graph, texts
from channelgraph.schemas import MESSAGES, TABLES, TEXT_REF


def rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


def test_references_hold_no_text(archive):
    assert "excerpt" not in TEXT_REF.fieldNames()
    shared = archive.slim_messages.filter("text_ref IS NOT NULL")
    assert shared.count() > 0 and shared.filter("excerpt IS NOT NULL OR content IS NOT NULL").count() == 0


def test_layer_of_references_equals_layer_of_texts(archive):
    plain = archive.messages
    want = graph.message_layer(graph.scoped_forwards(plain), plain)
    slim = archive.slim_messages
    found = graph.message_layer(graph.scoped_forwards(slim), slim, archive.message_texts)
    assert want[0].filter("label IS NOT NULL").count() > 0
    assert [rows(df) for df in found] == [rows(df) for df in want]
    with pytest.raises(ValueError):
        graph.message_layer(graph.scoped_forwards(slim), slim)


def test_stub_takes_the_newest_text_that_can_be_shown(spark):
    """Blank beginnings, null and own texts among shared ones."""
    stored = spark.createDataFrame([(0, "  first "), (1, " " * EXCERPT_CHARS + "late"), (2, None)], "text_id long, content string")
    names = ("id", "peer_external_id", "telegram_message_id", "content")
    given = [(1, -100, 1, None, 0), (2, -200, 2, None, 1), (3, -300, 3, None, 2), (4, -400, 4, "own", None)]
    full = [{**dict.fromkeys(MESSAGES.fieldNames()), **dict(zip(names, r))} for r in given]
    refs = spark.createDataFrame([(r[0], r[4]) for r in given], "id long, text_id long").join(texts.references(stored), "text_id", "left")
    header = F.from_json(F.lit('{"from_id":{"_":"PeerChannel","channel_id":"9"},"channel_post":"5"}'), MESSAGES["fwd_from"].dataType)
    made = spark.createDataFrame(full, MESSAGES).join(refs.drop("text_id"), "id").withColumns(
        {"fwd_from": header, "date": F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT))")}
    )
    for upto, label in ((3, "first"), (4, "own")):
        nodes, _ = graph.message_graph(made.filter(F.col("id") <= upto), stored)
        assert [r["label"] for r in nodes.collect()] == [label]
    assert nodes.columns == TABLES["graph_nodes"].fieldNames()
