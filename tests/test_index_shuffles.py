"""What the indexes leave where it lies: rows that a page or a scope has no use for are not shuffled."""

from __future__ import annotations

import pytest

from channelgraph.operators import merge
from channelgraph.operators.origin_index import OriginIndex


def plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture
def limit(spark):
    """Sets what Spark may broadcast, as large tables would."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def test_messages_of_a_scope_are_not_shuffled(spark, archive, tmp_path, limit):
    merge.write_by_month(archive.slim_messages, str(tmp_path / "messages"))
    index = OriginIndex(spark, str(tmp_path / "messages"), str(tmp_path / "origins"))
    index.rebuild()
    found = index.scope(-1000000000001, "2024-01-08", "2024-01-20")
    limit("4KB")  # more than the keys of the scope take, less than the stored messages
    whole = index.whole(found)
    assert "BroadcastHashJoin" in plan(spark, whole) and "SortMergeJoin" not in plan(spark, whole)
    assert sorted(r["id"] for r in whole.collect()) == sorted(r["id"] for r in found.collect())
