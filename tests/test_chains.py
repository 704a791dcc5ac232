"""Chains that no task can hold give what all others give."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chains
from ledgerlens.queries.derived import records
from ledgerlens.sources.lists import load_config

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A tenth of all events, and more, belong to one object."""
    rows = records(spark, SF)
    hot = F.when(F.col("source_order") % 9 == 0, "HOT").when(F.col("source_order") % 9 == 1, "HOT2").otherwise(F.col("object_id"))
    return rows.withColumn("object_id", hot)


def as_rows(frame):
    columns = sorted(frame.columns)
    return sorted((str(r) for r in frame.select(*columns).collect()))


@pytest.mark.parametrize("most", [0, 100])
def test_segments_give_what_windows_give(spark, skewed, most):
    assert as_rows(chains.in_chain_order(skewed, most)) == as_rows(chains.in_chain_order(skewed))
    assert as_rows(chains.with_chain(skewed, most)) == as_rows(chains.with_chain(skewed))


def test_one_object_spreads_over_tasks(spark, skewed):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = chains.keyed(skewed.where("object_id = 'HOT'"))
        ranges = chains.in_segments(one).groupBy(F.shiftright("number", 0).alias("n")).count()
        sizes = [r["count"] for r in one.repartitionByRange("object_id", *chains.CHAIN_ORDER).groupBy(F.spark_partition_id()).count().collect()]
        assert ranges.count() == one.count() and len(sizes) >= 12 and max(sizes) < one.count() / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_records(spark, skewed):
    none = skewed.limit(0)
    assert chains.enriched(none, load_config().onset, None).collect() == [] and chains.in_chain_order(none, 0).collect() == []
