"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, oracle, sf_dir):
    ok, note = compare(spark, oracle, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"evid1", "evid2", "dt", "X", "Y", "Z", "phase"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
