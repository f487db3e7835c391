"""Queries on order lines deal them to tasks of counted size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from daybook import tables
from daybook.plans import bindings

NAMES = ["e12_strays", "c11_alterations", "d09_date_union", "f14_filter_after_scoring", "s05_attach_appearances", "c03_in_collection", "s08_date_ranges"]


def rows(df):
    return sorted(map(str, df.collect()))


def test_tasks_of_counted_size(spark, sf, monkeypatch):
    n = bindings.printed_rows(spark, sf)
    monkeypatch.setattr(tables, "TASK_ROWS", n // 20)
    with tables.changed(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        held = bindings.printed(spark, sf).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 15 and max(r["count"] for r in held) < n // 5


@pytest.mark.parametrize("name", NAMES)
def test_dealing_changes_no_row(spark, sf, monkeypatch, name):
    query = __spark_entry__.queries()[name]
    want = rows(query(spark, sf))
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    with tables.changed(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert rows(query(spark, sf)) == want != []
