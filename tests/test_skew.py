"""A key with a third of all rows: results stay whole and the join is split."""

import pytest
from pyspark.sql import functions as F

from plumbrow.operators import catalog, lineage, profile

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    # Tiny partitions would all be merged, and a partition written by one task cannot be split.
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def target():
    return F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 500))


def test_a_parent_of_a_third_of_all_tables(spark, small_partitions):
    n = 60_000
    tables = spark.range(n).select(F.lit("d").alias("domain"), F.concat(F.lit("c"), "id").alias("table"))
    parents = spark.range(500).select(F.lit("d").alias("domain"), F.concat(F.lit("t"), "id").alias("table"))
    hot = spark.createDataFrame([("d", "hot")], "domain string, table string")
    registry = tables.union(parents).union(hot).withColumn("urn", F.col("table"))
    fks = spark.range(n).select(F.concat(F.lit("c"), "id").alias("urn"), target().alias("target_table"))
    edges = lineage.fk_edges(registry, fks)
    rows = edges.collect()
    assert len(rows) == n and sum(r.src == "hot" for r in rows) == n // 3
    assert "skew=true" in final_plan(edges)


def test_a_dataset_with_a_third_of_all_rows(spark, small_partitions):
    n = 60_000
    rows = spark.range(n).select(target().alias("dataset"), (F.col("id") - n // 2).alias("v"))
    found = profile.negative_profile(rows, by="dataset").filter("dataset = 'hot'").first()
    assert (found.bad_rows, found.total_rows, found.min_value) == (n // 6, n // 3, -n / 2)


def test_a_table_with_a_third_of_all_tags(spark, small_partitions):
    n = 60_000
    given = spark.range(n).select(
        F.lit("tag").alias("kind"), F.concat(F.lit("tag"), F.col("id") % 7).alias("value"),
        target().alias("table"), F.col("id").alias("position"),
    )
    registry = spark.createDataFrame([("u", "hot")], "urn string, table string")
    assert catalog.attach_metadata(registry, given).first().tags == [f"tag{i}" for i in range(7)]
    unknown = catalog.unknown_assignments(registry, given).count()
    assert unknown == n - n // 3
