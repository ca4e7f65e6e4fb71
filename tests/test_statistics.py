"""Python statistics merged from bounded states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.operators import metrics, statistics


def lower_quantile(values, weights, fraction):
    order = np.argsort(values)
    upto = np.cumsum(np.array(weights)[order])
    return float(np.array(values)[order][np.searchsorted(upto, fraction * upto[-1])])


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_weighted_quantile(spark, fraction):
    rng = np.random.default_rng(3)
    rows = [(["hot", None, f"k{i % 9}"][int(rng.choice(3, p=[0.6, 0.1, 0.3]))], float(rng.integers(-9, 9)), float(rng.integers(1, 6))) for i in range(3000)]
    df = spark.createDataFrame(rows + [("hot", None, 1.0), ("none", 2.0, None)], "k string, v double, w double").repartition(13)
    got = {r.k: r.statistic for r in statistics.aggregate_statistic(df, ["k"], "v", statistics.WeightedQuantile(fraction), "w").collect()}
    want = {k: lower_quantile(*zip(*[(v, w) for n, v, w in rows if n == k]), fraction) for k in {r[0] for r in rows}}
    assert got == want
    whole = statistics.aggregate_statistic(df, [], "v", statistics.WeightedQuantile(fraction), "w").collect()
    assert [r.statistic for r in whole] == [lower_quantile(*zip(*[r[1:] for r in rows]), fraction)]


def test_states_are_bounded_and_empty_input_gives_no_rows(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="more than 1000 bytes"):
        statistics.aggregate_statistic(df, [], "v", statistics.WeightedQuantile(), most_bytes=1000).collect()
    rounded = statistics.aggregate_statistic(df, [], "v", statistics.WeightedQuantile(step=1000.0), most_bytes=10_000).collect()
    assert rounded[0].statistic == 10_000.0
    assert statistics.aggregate_statistic(df.where("v < 0"), [], "v", statistics.WeightedQuantile()).count() == 0


def test_bootstrap_of_a_python_statistic(spark):
    class TrimmedMean:
        """Any object with the four methods will do."""

        def start(self):
            return 0.0, 0.0

        def update(self, state, values, weights):
            inside = np.abs(values) < 50
            return state[0] + float((values * weights)[inside].sum()), state[1] + float(weights[inside].sum())

        def merge(self, one, other):
            return one[0] + other[0], one[1] + other[1]

        def finish(self, state):
            return state[0] / state[1] if state[1] else None

    df = spark.range(400).select(F.col("id").cast("double").alias("v"), (F.col("id") % 20).alias("g"))
    trimmed = lambda v, w: F.sum(F.when(F.abs(v) < 50, v * w)) / F.sum(F.when(F.abs(v) < 50, w))
    one = metrics.cluster_bootstrap(df, "v", "g", 50, statistic=trimmed).first()
    two = metrics.cluster_bootstrap(df, "v", "g", 50, statistic=TrimmedMean()).first()
    assert one == two and one.estimate == 24.5
