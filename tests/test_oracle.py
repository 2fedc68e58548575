"""Every registered query against independent SQL over the same tables."""

import ast
import inspect

import pytest
from compare import connect, differences
from conftest import SF_DIR

import __spark_entry__ as entry_file
from channelgraph.plans import queries as queries_file
from channelgraph.plans.queries import QUERIES

ORACLES = entry_file.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)
    assert set(QUERIES) <= set(entry_file.queries())


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(QUERIES)))
def test_matches_oracle(spark, duck, name):
    assert differences(entry_file.queries()[name](spark, SF_DIR), duck, ORACLES[name]) == []


def test_no_helper_replaces_another():
    body = ast.parse(inspect.getsource(queries_file)).body
    names = [f.name for f in body if isinstance(f, ast.FunctionDef)]
    assert len(names) == len(set(names))


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0
