"""Sums of money per order are shuffled as longs and equal sums of decimals to the last bit."""

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import Tables


def test_study_sums_are_narrow_and_exact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    got = views.study(t).select("id", "mlip", "dft")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(" in plan and "as decimal(18,6)))" not in plan.replace("* 1000000", "")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    money = lambda c: F.sum(c.cast("decimal(18,6)")).cast("double")
    want = t.lineitem.groupBy("l_orderkey").agg(money(price).alias("mlip"), money(price * (1 + F.col("l_tax"))).alias("dft"))
    want = t.orders.join(want, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "mlip", "dft")
    assert got.count() and not got.exceptAll(want).count() and not want.exceptAll(got).count()
