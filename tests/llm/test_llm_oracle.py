"""Registered queries against their SQL twins."""

import pytest

import __spark_entry__ as entry
from stationlake.llm.queries import ORACLE_SQL, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note


def test_all_queries_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
