"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {f"p{n}_found" for n in (3, 4, 5, 6)} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
