"""The projection of star-schema tables: what a task holds of them."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import projection

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return [spark.read.parquet(f"{SF}/{name}.parquet") for name in ("lineitem", "orders")]


def test_a_task_sums_a_bounded_number_of_rows(spark, tables, monkeypatch):
    """More lines make more tasks: none is merged into a larger one, however small its bytes are."""
    whole = sorted(map(tuple, projection.weekly_units(*tables).collect()))
    monkeypatch.setattr(projection, "TASK_ROWS", 200, raising=False)
    units = projection.weekly_units(*tables)
    most = units.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert len(whole) > 10_000 and most < 200 * 3  # songs count for two charts
    assert sorted(map(tuple, units.collect())) == whole


def test_rows_without_an_item_count_for_no_chart(spark, tables):
    lineitem, orders = tables
    none = lineitem.withColumn("l_partkey", F.lit(None).cast("long")).withColumn("l_suppkey", F.lit(None).cast("long"))
    found = projection.weekly_units(lineitem.unionByName(none), orders.withColumn("o_custkey", F.lit(None).cast("long")))
    wanted = projection.weekly_units(lineitem, orders).where("chart_id <> 2")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert projection.weekly_units(lineitem.where("false"), orders.where("false")).collect() == []
