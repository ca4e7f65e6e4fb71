import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.operators import ordered, pairs


def brute_auroc(y, s):
    pos = [v for v, l in zip(s, y) if l]
    neg = [v for v, l in zip(s, y) if not l]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(y, s):
    if not sum(y):
        return None
    area, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        kept = [l for l, v in zip(y, s) if v >= t]
        recall = sum(kept) / sum(y)
        area += (recall - before) * sum(kept) / len(kept)
        before = recall
    return area


@pytest.mark.parametrize("seed,edges", [(1, ()), (2, (0.2, 0.21, 0.7)), (3, (-5.0, 0.5))])
def test_auroc_and_ap_match_counting(spark, seed, edges):
    rng = random.Random(seed)
    y = [int(rng.random() < 0.4) for _ in range(120)]
    s = [round(rng.random(), 1) for _ in y]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double").repartition(5)
    assert ordered.auroc(df, "y", "s", edges=edges).first()[0] == pytest.approx(brute_auroc(y, s))
    assert ordered.average_precision(df, "y", "s", edges=edges).first()[0] == pytest.approx(brute_ap(y, s))


def test_undefined_and_tied(spark):
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert ordered.auroc(tied, "y", "s").first()[0] == 0.5
    assert ordered.average_precision(tied, "y", "s").first()[0] == 0.5
    one = spark.createDataFrame([(0, 0.1), (0, 0.5)], "y int, s double")
    assert ordered.auroc(one, "y", "s").first()[0] is None
    assert ordered.average_precision(one, "y", "s").first()[0] is None


def test_risk_coverage_ties(spark):
    df = spark.createDataFrame([(0.0, 0.3), (1.0, 0.3)], "l double, u double")
    assert [tuple(r) for r in ordered.risk_coverage(df, "l", "u").collect()] == [(1.0, 0.5, 0.3, 2)]


@pytest.mark.parametrize("edges", [(), (1.5, 2.5), (3.0,)])
def test_pareto_against_brute_force(spark, edges):
    rng = random.Random(7)
    pts = [(float(rng.randint(0, 5)), float(rng.randint(0, 6))) for _ in range(60)] + [(1.0, 3.0), (2.0, 2.0), (3.0, 3.0)]
    want = sorted(p for p in pts if not any(
        q[0] <= p[0] and q[1] <= p[1] and (q[0] < p[0] or q[1] < p[1]) for q in pts))
    df = spark.createDataFrame(pts, "c double, r double")
    assert sorted(map(tuple, ordered.pareto_frontier(df, "c", "r", edges=edges).collect())) == want


@pytest.mark.parametrize("edges", [(), (10.0, 40.0)])
def test_exact_quantiles(spark, edges):
    rng = random.Random(3)
    data = {k: [float(rng.randint(0, 50)) for _ in range(n)] for k, n in (("a", 41), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r for r in ordered.exact_quantiles(df, "v", {"med": 0.5, "hi": 0.975}, ["k"], edges).collect()}
    for k, vs in data.items():
        assert got[k].med == pytest.approx(np.quantile(vs, 0.5))
        assert got[k].hi == pytest.approx(np.quantile(vs, 0.975))


def test_edges_spread_a_large_column(spark):
    df = spark.range(10_000).select((F.col("id") % 1000).cast("double").alias("v"))
    edges = ordered.value_edges(df, "v", rows_per_bucket=1000)
    assert 8 <= len(edges) <= 10
    sizes = ordered.with_bucket(df, "v", edges).groupBy("_bucket").count().toPandas()["count"]
    assert sizes.max() <= 1200


def brute_pairs(rows):
    resolved = correct = unresolved = 0
    for (c1, r1, u1), (c2, r2, u2) in itertools.combinations(rows, 2):
        if None in (c1, r1, c2, r2) or abs(r1 - r2) <= (u1 or 0) + (u2 or 0):
            unresolved += 1
            continue
        resolved += 1
        correct += (c1 - c2 > 0) == (r1 - r2 > 0) and c1 != c2
    return resolved, unresolved, correct


@pytest.mark.parametrize("rows_per_bucket", [500_000, 10, 3])
def test_decision_pairs_against_all_pairs(spark, rows_per_bucket):
    rng = random.Random(11)
    groups = {f"g{i}": [
        (rng.choice([None, *map(float, range(10))]), rng.choice([None, *map(float, range(12))]),
         rng.choice([None, 0.0, 1.0, 2.5])) for _ in range(n)] for i, n in enumerate((1, 2, 3, 17, 40))}
    df = spark.createDataFrame(
        [(g, *r) for g, rs in groups.items() for r in rs], "g string, c double, r double, u double")
    got = {x.g: x for x in pairs.decision_pairs(df, "g", "c", "r", "u", rows_per_bucket).collect()}
    for g, rows in groups.items():
        assert (got[g].resolved, got[g].unresolved, got[g].correct) == brute_pairs(rows), g


@pytest.mark.parametrize("rows_per_bucket", [500_000, 3])
def test_ordering_accuracy_against_all_pairs(spark, rows_per_bucket):
    rng = random.Random(5)
    groups = {f"g{i}": [(float(rng.randint(0, 8)), float(rng.randint(0, 8))) for _ in range(n)]
              for i, n in enumerate((1, 2, 9, 30))}
    df = spark.createDataFrame([(g, *r) for g, rs in groups.items() for r in rs], "g string, c double, r double")
    rel = lambda d, t: 0 if abs(d) <= t else (1 if d > 0 else -1)
    for tol in (1e-8, 1.5):
        got = {x.g: x for x in pairs.ordering_accuracy(df, "g", "c", "r", tol, rows_per_bucket).collect()}
        for g, rows in groups.items():
            ps = list(itertools.combinations(rows, 2))
            want = sum(rel(a[0] - b[0], tol) == rel(a[1] - b[1], tol) for a, b in ps) / len(ps) if ps else 1.0
            assert got[g].ordering_accuracy == pytest.approx(want), (g, tol)


@pytest.mark.parametrize("rows_per_bucket", [1_000, 100, 4])
def test_results_do_not_depend_on_the_buckets(spark, rows_per_bucket):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), int(rng.random() < 0.4), round(rng.random(), 2), float(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, y int, s double, c double").repartition(4)
    few, many = (), ordered.value_edges(df, "s", rows_per_bucket)
    assert len(many) + 1 == {1_000: 1, 100: 2, 4: 50}[rows_per_bucket] or rows_per_bucket == 4 and len(many) > 20
    same = lambda run: sorted(map(tuple, run(few).collect()), key=str) == sorted(map(tuple, run(many).collect()), key=str)
    rounded = lambda frame: frame.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in frame.dtypes])
    assert same(lambda e: rounded(ordered.auroc(df, "y", "s", ["k"], e)))
    assert same(lambda e: rounded(ordered.average_precision(df, "y", "s", ["k"], e)))
    assert same(lambda e: rounded(ordered.risk_coverage(df, "c", "s", ["k"], e)))
    assert same(lambda e: ordered.exact_quantiles(df, "s", {"m": 0.5, "h": 0.9}, ["k"], e))
    assert same(lambda e: ordered.pareto_frontier(df, "s", "c", e))
    assert {r.k for r in ordered.auroc(df, "y", "s", ["k"], many).collect()} == {"a", "b", None}


def test_missing_values_are_refused(spark):
    for row in ((None, 0.5), (1, None), (1, float("nan"))):
        df = spark.createDataFrame([(0, 0.1), row], "y int, s double")
        for run in (ordered.auroc, ordered.average_precision, ordered.risk_coverage):
            with pytest.raises(Exception, match="is missing"):
                run(df, "y", "s").collect()
    points = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "c double, r double")
    with pytest.raises(Exception, match="is missing"):
        ordered.pareto_frontier(points, "c", "r").collect()
