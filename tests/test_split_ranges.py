"""The partition of a row is told by its group, so rows with operations are not joined with the split."""

import pytest
from pyspark.sql import functions as F

from tierlens.operators.splits import grouped_split, partition_of
from tierlens.plans import study as P
from tierlens.sources.synthetic import synthetic_ids, synthetic_study


@pytest.mark.parametrize("seed", [42, 7])
def test_partition_of_is_that_of_the_split(spark, seed):
    rows = spark.range(900).select("id", (F.col("id") % 83).alias("group_id"))
    split = grouped_split(rows, seed=seed)
    told = rows.where("id % 2 = 0").select("id", "group_id", partition_of(split, seed=seed).alias("partition"))
    assert told.exceptAll(split).count() == 0 and told.where("partition is null").count() == 0
    assert told.select("partition").distinct().count() == 4
    none = spark.createDataFrame([(1, None)], "id long, group_id long")
    assert none.select(partition_of(split, seed=seed)).first()[0] is None


def test_study_rows_are_not_written_with_their_operations(spark, monkeypatch):
    rows = synthetic_study(synthetic_ids(spark, groups=24, rows_per_group=3)).localCheckpoint()
    written, cut = [], P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    artifact = P.fit_study(rows, P.StudyConfig(synthetic=True), pairwise=False)
    assert len(written) >= 4 and not any("operations" in names or "costs" in names for names in written)
    sizes = {r["partition"]: r["n"] for r in artifact.split.groupBy("partition").agg(F.count("*").alias("n")).collect()}
    n = {m.model.n for m in artifact.models.values()}
    assert max(n) <= sizes["train"] and artifact.validation.first()["n"] == sizes["validation"]
