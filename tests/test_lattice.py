"""Threshold grids counted on a lattice against the replay of every definition, and pair counts against all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.operators import ledger, pair_index, pairs, replay

SCHEMA = ("id long, group_id long, ord long, decision_group string, mlip double, dft double, reference double, reference_uncertainty double, "
          "high_level_value double, high_level_supported boolean, cheap_screen double, risk_surrogate double, risk_total double, reference_risk double, "
          "operations map<string,map<string,double>>, costs map<string,double>")
COSTS = {"mlip": 0.03, "dft": 1.0, "high_level": 20.0, "screen": 0.05, "diagnostics": 0.3}


def some_rows(n=260, seed=7):
    rng = np.random.default_rng(seed)
    maybe = lambda x, p=0.15: None if rng.random() < p else float(x)
    steps = [0.0, 0.1, 0.25, 0.3, 0.5, 0.75, 0.9, 1.0]
    out = []
    for i in range(n):
        value = rng.normal() * 3
        # a hot group with a third of the rows, ties, operations that rows share and buy in several steps
        group = ["hot", None, f"g{rng.integers(25)}"][rng.choice(3, p=[0.35, 0.1, 0.55])]
        shared = {f"op{k}": 1.0 + int(k) % 3 for k in rng.choice(40, 2, replace=False)}
        operations = {"dft": shared} | ({"high_level": {f"op{rng.integers(40, 60)}": 7.0, **shared}} if rng.random() < 0.4 else {})
        out.append((i, i, i, group, maybe(np.round(value + rng.normal(), 1)), maybe(np.round(value + rng.normal() * 0.3, 1)),
                    maybe(np.round(value, 1), 0.05), maybe(0.2, 0.5), maybe(value), bool(rng.random() < 0.7), maybe(rng.choice(steps), 0.3),
                    maybe(rng.choice(steps)), maybe(rng.choice(steps)), maybe(rng.choice(steps)), operations, COSTS))
    return out


def every_definition():
    grid = replay.default_grid((0.1, 0.25, 0.5, 0.75, 0.9), True)
    return grid + [{"name": m, "mode": m} for m in ("always_mlip", "always_dft", "always_high_level")] + [grid[3], {"name": "screened", "use_screen": True, "t_screen": 0.25}]


@pytest.mark.parametrize("flags", [(True, True), (False, False)])
def test_grid_is_the_replay_of_every_definition(spark, flags):
    rows = spark.createDataFrame(some_rows(), SCHEMA)
    definitions = every_definition()
    got = {r.policy_id: r for r in replay.policy_grid(rows, definitions, 0.8, 0.05, 20.0, *flags).collect()}
    paths = replay.run_policies(rows, definitions, 0.8, *flags)
    paid = ledger.apply_ledger(paths, ledger.charges(ledger.purchases(paths, ["policy_id"], "ord"), ["policy_id"]), ["policy_id"], 0.8)
    want = {r.policy_id: r for r in replay.replay_summary(paid, ["policy_id"]).collect()}
    assert set(got) == set(want) == set(range(len(definitions)))
    for p, w in want.items():
        for c in w.asDict():
            a, b = got[p][c], w[c]
            assert a == b if isinstance(b, int) or b is None else a == pytest.approx(b, rel=1e-9), (definitions[p], c)


def test_large_grids_and_empty_tables(spark):
    thresholds = tuple(i / 20 for i in range(1, 21))
    grid = [{"name": "s", "t1": a, "t2": b} for a in thresholds for b in thresholds]
    rows = spark.createDataFrame(some_rows(80), SCHEMA)
    got = replay.policy_grid(rows, grid, 0.8).toPandas().set_index("policy_id")
    some = [0, 57, 210, 399]
    few = replay.policy_grid(rows, [grid[p] for p in some], 0.8).toPandas().set_index("policy_id")
    for n, p in enumerate(some):
        numbers = lambda row: row.drop(["name", "definition_digest"]).astype(float)
        assert np.allclose(numbers(got.loc[p]), numbers(few.loc[n]), rtol=1e-12, equal_nan=True)
    assert replay.policy_grid(spark.createDataFrame([], SCHEMA), grid[:3], 0.8).count() == 0


def all_pairs(rows, tolerance):
    """(resolved, correct) over pairs of (group, prediction, reference, uncertainty)."""
    resolved = correct = 0
    for a, b in itertools.combinations([r for r in rows if r[1] is not None and r[2] is not None], 2):
        if a[0] != b[0]:
            continue
        gap, margin = a[2] - b[2], (a[3] or 0) + (b[3] or 0) + tolerance
        if abs(gap) > margin:
            resolved += 1
            c = a[1] - b[1]
            correct += (c > tolerance and gap > 0) or (c < -tolerance and gap < 0)
    return resolved, correct


@pytest.mark.parametrize("tolerance", [0.0, 0.75])
@pytest.mark.parametrize("rows_per_bucket", [10 ** 6, 9])
def test_pair_index_against_all_pairs(spark, tolerance, rows_per_bucket):
    rng = np.random.default_rng(1)
    # multiples of 1/4: gaps and tolerances are exact
    quarter = lambda n: None if rng.random() < 0.1 else float(rng.integers(-n, n)) / 4
    data = [(["hot", f"g{rng.integers(8)}"][int(rng.random() < 0.6)], quarter(12), quarter(12), quarter(12), quarter(20), quarter(3) and 0.25, int(rng.integers(4)))
            for _ in range(150)]
    schema = "g string, x0 double, x1 double, x2 double, reference double, reference_uncertainty double, slot int"
    index = pair_index.interval_index(spark.createDataFrame(data, schema), "g", ["x0", "x1", "x2"], ["slot"], tie_tolerance=tolerance, rows_per_bucket=rows_per_bucket)
    active = [[0, 1, 2, 2], [1, 1, 0, 2], [2, 0, 0, 1], [0, 0, 0, 0]]  # [slot][policy]
    got = {r.policy_id: (r.resolved, r.correct) for r in pair_index.policy_pairs(index, ["slot"], [active], [10, 11, 12, 13]).collect()}
    want = {10 + p: all_pairs([(r[0], r[1 + active[r[6]][p]], r[4], r[5]) for r in data], tolerance) for p in range(4)}
    assert got == want and want[10][0] > 500
    plain = pairs.decision_pairs(spark.createDataFrame(data, schema), "g", "x1", rows_per_bucket=rows_per_bucket, tie_tolerance=tolerance)
    sums = plain.agg(F.sum("resolved"), F.sum("correct")).first()
    assert tuple(sums) == all_pairs([(r[0], r[2], r[4], r[5]) for r in data], tolerance)
