"""Every query that has SQL gives the rows of that SQL."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from cadenza.plans import catalogue

CORE = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    ours, theirs = compare(spark, name, "sf0.001")
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_every_query_has_sql_or_a_reason(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["recording_id", "speaker_id", "kind", "start_cs", "end_cs"]
