"""Shared texts stored once: references give what the texts themselves would give."""

import os

import pytest
from pyspark.sql import functions as F

from channelgraph.functions.text import excerpt, has_words
from channelgraph.operators import coverage, counts, merge, texts
from channelgraph.plans import queries
from channelgraph.schemas import MESSAGES, TABLES
from channelgraph.sources.derived import message_base, redelivered_messages
from channelgraph.streaming import jobs

CORE = MESSAGES.fieldNames()


def rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


def test_the_archive_keeps_each_text_once(archive):
    slim = archive.slim_messages
    assert slim.filter("trim(content) <> ''").count() == 0
    assert archive.message_texts.count() == archive.source.documents.count()
    content = F.expr("CASE WHEN event_id % 13 = 0 THEN '   ' WHEN event_id % 17 = 0 THEN NULL ELSE text END").alias("content")
    assert rows(archive.messages, "id", "content") == rows(message_base(archive.source).select(F.col("event_id").alias("id"), content))


def test_given_texts_are_not_written_again(archive):
    assert archive.message_texts.columns == TABLES["message_texts"].fieldNames()
    assert not os.path.exists(archive.path("message_texts"))
    assert all(f.startswith(f"file://{archive.source.sf_dir}/") for f in archive.message_texts.inputFiles())


def test_an_excerpt_is_stored_once_and_shown_everywhere(spark, archive, tmp_path):
    twice = F.col("text_ref").isNotNull() & F.col("excerpt").isNotNull()
    assert archive.slim_messages.filter(twice).count() == 0
    assert rows(archive.messages.filter("content = excerpt OR left(content, 20) = left(excerpt, 20)"), "id") == rows(archive.messages.filter("trim(content) <> ''"), "id")
    path = str(tmp_path / "by-month")
    merge.write_by_month(archive.slim_messages, path)
    merge.write_back(spark, path, redelivered_messages(message_base(archive.source)).filter("id % 3 = 0"))
    stored = spark.read.schema(TABLES["slim_messages"]).parquet(path)
    assert stored.filter(twice).count() == 0
    held = F.expr("excerpt")
    assert rows(texts.with_texts(stored, archive.message_texts).filter(~held.eqNullSafe(excerpt(F.col("content")))), "id") == []
    sent = spark.read.parquet(queries._twice(archive))
    assert sent.columns == jobs.DELIVERIES.fieldNames() and sent.count() == 2 * archive.slim_messages.count()


@pytest.mark.parametrize("order", [None, "id"])
def test_merging_references_equals_merging_texts(archive, order):
    delta = redelivered_messages(message_base(archive.source)).filter("id % 3 = 0")
    want = merge.merge_messages(archive.messages, delta, order)
    found = texts.with_texts(merge.merge_messages(archive.slim_messages, delta, order), archive.message_texts)
    assert rows(found, *CORE, "inserted") == rows(want, *CORE, "inserted")


def test_write_back_keeps_references_and_their_facts(spark, archive, tmp_path):
    path = str(tmp_path / "by-month")
    merge.write_by_month(archive.slim_messages, path)
    delta = redelivered_messages(message_base(archive.source)).filter("id % 3 = 0")
    merge.write_back(spark, path, delta)
    found = texts.with_texts(spark.read.schema(TABLES["slim_messages"]).parquet(path), archive.message_texts)
    assert rows(found, *CORE) == rows(merge.merge_messages(archive.messages, delta), *CORE)
    derived = found.drop("has_text", "excerpt")
    assert rows(counts.message_counts(found)) == rows(counts.message_counts(derived))
    plain = str(tmp_path / "plain")
    merge.write_by_month(archive.messages.limit(5), plain)
    with pytest.raises(ValueError):
        merge.write_back(spark, plain, archive.slim_messages.limit(1))


def test_facts_of_blank_null_and_missing_texts(spark):
    stored = spark.createDataFrame([(0, "  x "), (1, " \n\t "), (2, None), (3, "")], "text_id long, content string")
    refs = {r["text_id"]: r["text_ref"] for r in texts.references(stored).collect()}
    assert [(refs[i]["has_text"], refs[i]["has_words"]) for i in range(4)] == [(True, True), (True, False), (False, False), (False, False)]
    made = stored.select(F.col("text_id").alias("id"), F.lit(None).cast("string").alias("content")).join(
        texts.references(stored).withColumnRenamed("text_id", "id"), "id"
    )
    own = made.select((F.col("id") + 10).alias("id"), F.lit("own").alias("content"), F.lit(None).cast(made.schema["text_ref"].dataType).alias("text_ref"))
    both = made.unionByName(own)
    assert {(r["id"], r["content"]) for r in texts.with_texts(both, stored).collect()} == {
        (0, "  x "), (1, " \n\t "), (2, None), (3, ""), (10, "own"), (11, "own"), (12, "own"), (13, "own")
    }
    assert [r[0] for r in both.orderBy("id").select(has_words(both.columns)).collect()] == [True, False, False, False] + [True] * 4


def test_floors_are_repeated_for_busy_peers_only(spark, monkeypatch):
    message = "peer_external_id long, telegram_message_id long, day int"
    data = [(1, n, n) for n in range(1, 40)] + [(2, 5, 5), (3, None, 7), (None, 1, 9), (4, 1, 1)]
    date = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, day)").alias("date")
    messages = spark.createDataFrame(data, message).select("peer_external_id", "telegram_message_id", date)
    floor = spark.createDataFrame([(1, 20), (2, None), (4, 2), *[(n, 1) for n in range(100, 160)]], "peer_external_id long, min_id long")
    plain = rows(coverage.fetch_coverage(messages, floor))
    monkeypatch.setattr(coverage, "FLOOR_ROWS", 3)
    split = coverage.fetch_coverage(messages, floor)
    assert rows(split) == plain
    assert len(plain) == 4 and "2024, 1, 21" in plain[0] + plain[1] + plain[2] + plain[3]
    monkeypatch.setattr(coverage, "FLOOR_ROWS", 1000)
    plan = spark._jvm.PythonSQLUtils.explainString(coverage.fetch_coverage(messages, floor)._jdf.queryExecution(), "formatted")
    assert "sequence(0, 31" not in plan
