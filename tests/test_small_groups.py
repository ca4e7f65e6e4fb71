"""Pairs of small decision groups are formed where the group stands; only larger groups are indexed."""

import numpy as np
import pytest
from test_lattice import all_pairs

from tierlens.operators import lattice, pair_index, replay

SCHEMA = "g string, x0 double, x1 double, x2 double, reference double, reference_uncertainty double, slot int"
ACTIVE = [[0, 1, 2, 2], [1, 1, 0, 2], [2, 0, 0, 1], [0, 0, 0, 0]]  # [slot][policy]


def cases(rng, n):
    quarter = lambda k: None if rng.random() < 0.1 else float(rng.integers(-k, k)) / 4
    return [(["hot", f"g{rng.integers(8)}"][int(rng.random() < 0.6)], quarter(12), quarter(12), quarter(12), quarter(20), quarter(3) and 0.25, int(rng.integers(4)))
            for _ in range(n)]


@pytest.mark.parametrize("tolerance", [0.0, 0.75])
@pytest.mark.parametrize("pairs_at_once", [1 << 18, 7])
def test_small_groups_against_all_pairs(spark, monkeypatch, tolerance, pairs_at_once):
    data = cases(np.random.default_rng(3), 150)
    monkeypatch.setattr(pair_index, "_PAIRS_AT_ONCE", pairs_at_once)
    got = pair_index.small_group_pairs(
        spark.createDataFrame(data, SCHEMA), "g", ["x0", "x1", "x2"], ["slot"], [ACTIVE], [10, 11, 12, 13], tie_tolerance=tolerance)
    want = {10 + p: all_pairs([(r[0], r[1 + ACTIVE[r[6]][p]], r[4], r[5]) for r in data], tolerance) for p in range(4)}
    assert {r.policy_id: (r.resolved, r.correct) for r in got.collect()} == want and want[10][0] > 500


def test_only_larger_groups_are_indexed(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = lambda: None if rng.random() < 0.1 else float(rng.random())
    schema = ("id long, decision_group string, mlip double, dft double, reference double, reference_uncertainty double, high_level_value double, "
              "high_level_supported boolean, cheap_screen double, risk_surrogate double, risk_total double, reference_risk double")
    rows = spark.createDataFrame([
        (i, ["hot", f"g{i % 40}"][i % 3 > 0], float(rng.normal()), float(rng.normal()), float(rng.normal()), 0.1, float(rng.normal()), bool(i % 2), unit(), unit(), unit(), unit())
        for i in range(240)], schema)
    grid = lattice.lattices(replay.definition_table(replay.default_grid([0.25, 0.5], True)))
    scored = lattice.lattice_rows(rows, grid, ["id"])
    indexed = []
    index = lattice.interval_index
    monkeypatch.setattr(lattice, "interval_index", lambda some, *a, **k: indexed.append(some.select("decision_group").distinct().count()) or index(some, *a, **k))
    count = lambda limit: sorted(map(tuple, lattice.lattice_pairs(scored, grid, rows_per_bucket=limit).collect()))
    whole = count(None)
    assert indexed == []
    assert count(20) == whole and indexed == [1]  # "hot" has 80 rows, the others a few
    assert count(1) == whole and indexed[1] > 30
    assert sum(r[1] for r in whole) > 1000
