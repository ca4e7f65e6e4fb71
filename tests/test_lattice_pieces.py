"""A task that groups operations holds a bounded number of rows, however large the splits are."""

from tierlens.operators.lattice import in_pieces
from tierlens.plans.lineage import cut_lineage


def test_rows_are_dealt_into_pieces(spark):
    rows = cut_lineage(spark.range(1000).coalesce(1))
    assert rows.rdd.getNumPartitions() == 1
    assert in_pieces(rows, 100).rdd.getNumPartitions() == 10 and in_pieces(rows, 100).count() == 1000
    assert in_pieces(rows, 1000).rdd.getNumPartitions() == 1
