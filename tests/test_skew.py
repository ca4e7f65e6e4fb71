"""Half of all rows on one key: the join that meets it is split in the plan that ran."""

import pytest
from pyspark.sql import functions as F

from tierlens.operators import observables as O
from tierlens.operators import splits


@pytest.fixture
def splitting(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_structure_is_split(spark, splitting):
    terms = spark.range(0, 60_000, 1, 12).select(
        F.concat(F.lit("o"), F.col("id")).alias("observable_id"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("structure_id"), F.lit(1.0).alias("coefficient"))
    structures = spark.range(997).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit("g").alias("geometry_hash")).unionByName(
        spark.createDataFrame([("hot", "g")], "id string, geometry_hash string"))
    calculations = structures.select(
        F.col("id").alias("structure_id"), F.lit("A").alias("method_id"), F.lit("succeeded").alias("status"), F.lit(1.0).alias("energy"),
        F.lit("kcal/mol").alias("energy_unit"), "geometry_hash", F.lit(1.0).alias("cost"), F.lit("h").alias("cost_unit"), F.lit("x").alias("settings_hash"))
    records = O.term_records(terms, calculations, structures, ["A"])
    assert "skew=true" in executed(records)
    assert records.where("rec is null").count() == 0


def test_hub_entity_gives_one_component(spark, splitting):
    links = spark.range(0, 20_000, 1, 8).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("entity"))
    got = splits.connected_groups(links).groupBy("component").count().where("count > 1").collect()
    assert [(r.component, r["count"]) for r in got] == [(0, 10_000)]
