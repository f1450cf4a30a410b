"""Line items are dealt to as many tasks as their table asks for, with the same rows."""

import pytest

from tests.oracle import compare
from vistalake.plans import adapters, catalog, signals

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["set_signature", "diff_contracts", "preflight_sessions"])
def test_dealt_by_size(spark, monkeypatch, name):
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 1000)
    assert adapters.lines(spark, SF).rdd.getNumPartitions() == 6
    compare(spark, SF, catalog.QUERIES[name], catalog.SQL[name])


def test_events_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 100)
    n = -(-spark.read.parquet(f"{SF}/events.parquet").count() // 100)
    assert signals._signals(spark, SF)[1].rdd.getNumPartitions() == n
    compare(spark, SF, catalog.QUERIES["decode_stripes"], catalog.SQL["decode_stripes"])


def test_operations_in_one_pass(spark):
    wanted = adapters.with_primitives(spark, SF, adapters.OPERATIONS_SQL)
    found = adapters.operations(spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.select(*found.columns).collect()))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert (scans(found), scans(wanted)) == (1, 4)
