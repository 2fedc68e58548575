"""Queries that SQL can express, side by side with it."""

import pytest
from compare import FAMILY, connect, differences
from conftest import SF_DIR

from channelgraph.llm import registry

FAMILY.setdefault("int", "INTEGER")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_oracle(spark, name):
    assert differences(registry.queries()[name](spark, SF_DIR), connect(SF_DIR), registry.oracles()[name]) == []


def test_one_query_for_each_operator():
    names = list(registry.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names
