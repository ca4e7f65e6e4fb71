"""Hand-computed cases of the column functions, policies and small aggregates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.functions import columns as C
from tierlens.operators import features, metrics, models, policy, splits
from tierlens.operators.observables import assemble_observables, assemble_study
from tierlens.operators.replay import definition_table
from tierlens.records import EV_PER_HARTREE, KJ_MOL_PER_EV, KJ_PER_KCAL, check_feature_names


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_errors_and_labels(spark):
    df = spark.createDataFrame([(10.1, 10.0, 6.0)], "mlip double, dft double, reference double")
    got = df.select(*[c.alias(n) for n, c in C.error_decomposition("mlip", "dft", "reference").items()]).first()
    assert list(got) == pytest.approx([0.1, 4.0, 4.1])
    cases = [(4.0, 0.0, 0.5, 1), (3.0, 0.0, 0.5, None), (2.0, 0.0, 0.5, 0), (0.0, 0.0, None, 0)]
    df = spark.createDataFrame(cases, "p double, r double, u double, want int")
    assert all(r.got == r.want for r in df.select("want", C.target_label("p", "r", 3.0, "u").alias("got")).collect()[:3])
    assert one(spark, C.target_label(F.lit(0.0), F.lit(0.0), 1.0, F.lit(None).cast("double"))) == 0


def test_finite_treats_nan_and_infinity_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (math.inf,), (None,)], "x double")
    assert [r[0] for r in df.select(C.finite("x")).collect()] == [True, False, False, False]


def test_small_formulas(spark):
    assert one(spark, C.spin_contamination(F.lit(0.8), F.lit(2))) == pytest.approx(0.05)
    gap = C.orbital_gap(F.lit([-10.0, -3.0, 2.0, 4.0]), F.lit([2.0, 2.0, 0.0, 0.0]))
    assert one(spark, gap) == 5.0
    assert one(spark, C.sigmoid(F.lit(-1000.0))) == 0.0 and one(spark, C.sigmoid(F.lit(1000.0))) == 1.0
    hartree = one(spark, C.convert_energy(F.lit(0.01), F.lit("hartree"), F.lit("kcal/mol")))
    assert hartree == pytest.approx(0.01 * EV_PER_HARTREE * KJ_MOL_PER_EV / KJ_PER_KCAL)
    assert one(spark, C.convert_energy(F.lit(1.0), F.lit("cal"), F.lit("eV"))) is None
    assert one(spark, C.escalate_once(F.lit(0.9), F.lit(0.5))) == "run_dft"
    assert one(spark, C.escalate_once(F.lit(0.9), F.lit(0.55))) == "run_high_level"
    s = C.vector_summary(F.lit([1.0, 3.0]))
    assert one(spark, s["std"]) == pytest.approx(math.sqrt(2))
    df = spark.createDataFrame([("a", {"x": 0.2, "y": 0.8}), ("b", {"x": 0.2})], "id string, features map<string,double>")
    got = {r.id: r.weighted_risk for r in metrics.weighted_risk(df, {"x": 1.0, "y": 3.0}).collect()}
    assert got["a"] == pytest.approx(0.65) and got["b"] is None


def test_feature_guard():
    check_feature_names(["ensemble_std", "fod"], 1)
    for names, stage in (([], 1), (["fod"], 0), (["t1_diagnostic"], 1), (["new"], 1), (["fod", "fod"], 1)):
        with pytest.raises(ValueError):
            check_feature_names(names, stage)


def test_conformal(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -10.0), ("b", 2.0), ("c", 3.0)], "g string, r double")
    fit = metrics.fit_conformal(df, "r", "g", 0.5).first()
    assert (fit.groups, fit.rank, fit["quantile"], fit.bounded) == (3, 2, 3.0, True)
    lone = metrics.fit_conformal(df.where("g = 'a'"), "r", "g", 0.1).first()
    assert lone["quantile"] is None and not lone.bounded


def test_preprocessor(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "ensemble_std double, fod double")
    fitted = features.fit_preprocessor(df, ["ensemble_std", "fod"], 1)
    assert fitted.medians == (2.0, 0.0) and fitted.all_missing == (False, True)
    later = spark.createDataFrame([(None, 7.0)], "ensemble_std double, fod double")
    row = fitted.apply(later).first()
    assert (row.z_fod, row.missing_fod, row.missing_ensemble_std) == (0.0, 1.0, 1.0) and row.z_ensemble_std == pytest.approx(0.0)
    assert features.Preprocessor.from_dict(fitted.to_dict()) == fitted


def newton(x, y, l2):
    """Plain Newton iteration for two parameters, to compare the fit with."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = [1 / (1 + math.exp(-(a + b * v))) for v in x]
        g0, g1 = sum(q - t for q, t in zip(p, y)), sum((q - t) * v for q, t, v in zip(p, y, x)) + l2 * b
        w = [q * (1 - q) for q in p]
        h00, h01, h11 = sum(w), sum(q * v for q, v in zip(w, x)), sum(q * v * v for q, v in zip(w, x)) + l2
        d = h00 * h11 - h01 * h01
        a, b = a - (h11 * g0 - h01 * g1) / d, b - (h00 * g1 - h01 * g0) / d
    return a, b


def test_logistic_matches_newton_and_single_class(spark):
    x = [-2.0, -1.0, -0.5, 0.0, 0.3, 0.9, 1.5, 2.5, 3.0, -3.0]
    y = [0, 0, 1, 0, 1, 0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y int")
    for l2 in (1.0, 0.1):
        fit = models.fit_logistic(df, ["x"], "y", l2)
        assert (fit.intercept, fit.coef[0]) == pytest.approx(newton(x, y, l2), abs=1e-5)
    constant = models.fit_logistic(df.where("y = 1").limit(2), ["x"], "y")
    assert constant.constant_probability == pytest.approx(2.5 / 3)
    assert one(spark, constant.probability([F.lit(9.0)])) == pytest.approx(2.5 / 3)
    assert models.LogisticModel.from_dict(fit.to_dict()) == fit


def test_models_fitted_together_are_optimal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1.0, 5.0, 0.1]
    labels = {f"y{k}": (rng.random(500) < 1 / (1 + np.exp(-x @ w))).astype(float) for k, w in enumerate(([1, 0.2, 0], [-2, 0.5, 3], [0, 0, 30]))}
    labels["y1"][:50] = np.nan  # a missing label leaves the row to the other models
    labels["one"] = np.ones(500)
    rows = [(*map(float, v), *[None if np.isnan(labels[n][i]) else int(labels[n][i]) for n in labels]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y0 int, y1 int, y2 int, one int").repartition(5)
    wanted = {"first": (["a", "b", "c"], "y0", 1.0), "second": (["b", "a"], "y1", 0.5), "third": (["c"], "y2", 2.0), "constant": (["a"], "one", 1.0)}
    fitted = models.fit_logistics(df, wanted)
    for name, (inputs, label, l2) in wanted.items():
        m = fitted[name]
        assert m.converged
        if label == "one":
            assert m.constant_probability == pytest.approx(500.5 / 501) and m.positives == m.n == 500
            continue
        known = ~np.isnan(labels[label])
        z, y = np.column_stack([np.ones(known.sum()), x[known][:, ["abc".index(c) for c in inputs]]]), labels[label][known]
        gradient = z.T @ (1 / (1 + np.exp(-z @ [m.intercept, *m.coef])) - y) + l2 * np.array([0.0, *m.coef])
        assert np.abs(gradient).max() < 1e-6 and m.n == known.sum() and 0 < m.iterations < 20
    # separated classes: steps must be halved or many, and still end
    steep = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "a double, y0 int")
    m = models.fit_logistics(steep, {"m": (["a"], "y0", 1e-6)})["m"]
    assert m.converged and m.coef[0] > 1
    with pytest.raises(ValueError, match="no training rows"):
        models.fit_logistics(df.where("a > 1e9"), {"m": (["a"], "y0", 1.0)})


def test_connected_groups(spark):
    links = [("a", "ts1"), ("b", "ts1"), ("b", "scaffold"), ("c", "scaffold"), ("d", "other"), ("e", None)]
    got = dict(splits.connected_groups(spark.createDataFrame(links, "row_id string, entity string")).collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    # a long chain and a hub
    chain = [(i, f"e{i}") for i in range(40)] + [(i + 1, f"e{i}") for i in range(40)] + [(i, "hub") for i in range(100, 160)]
    got = dict(splits.connected_groups(spark.createDataFrame(chain, "row_id long, entity string")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}


def test_split_sizes_and_order_invariance(spark):
    assert splits.partition_sizes(20, splits.DEFAULT_FRACTIONS) == {"train": 9, "calibration": 4, "validation": 4, "test": 3}
    with pytest.raises(ValueError):
        splits.partition_sizes(3, splits.DEFAULT_FRACTIONS)
    rows = [(f"r{i}", f"g{i % 20}") for i in range(60)]
    a = splits.grouped_split(spark.createDataFrame(rows, "id string, group_id string"))
    b = splits.grouped_split(spark.createDataFrame(rows[::-1], "id string, group_id string").repartition(7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert not any(r.violations for r in splits.split_audit(a, a).collect())


# ---- replay ------------------------------------------------------------------

ROW = dict(id="a", group_id="g", mlip=5.0, dft=5.1, reference=0.0, reference_uncertainty=None, high_level_value=0.2,
           high_level_supported=True, cheap_screen=0.9, mlip_risk=0.1, reference_risk=0.9, use_diagnostics=True, use_reference_screen=False)


def play(spark, row=None, **definition):
    d = {k: v for k, v in definition_table([{"name": "p", **definition}])[0].items()}
    data = {**ROW, **(row or {}), **d}
    schema = ("id string, group_id string, mlip double, dft double, reference double, reference_uncertainty double, high_level_value double, "
              "high_level_supported boolean, cheap_screen double, mlip_risk double, reference_risk double, use_diagnostics boolean, use_reference_screen boolean, "
              "policy_id int, name string, mode string, stage1 string, t1 double, t2 double, t_screen double, screen_all boolean, use_screen boolean, definition_digest string")
    return policy.replay_paths(spark.createDataFrame([tuple(data[f.split()[0]] for f in schema.split(", "))], schema), 1.0).first()


def test_replay_ladder(spark):
    low = play(spark)
    assert (low.action, low.purchased, low.correct) == ("accept_mlip", ["mlip"], False)
    full = play(spark, use_screen=True)
    assert (full.action, full.prediction, full.correct) == ("accept_high_level", 0.2, True)
    assert full.purchased == ["mlip", "screen", "dft", "diagnostics", "high_level"]
    failed = play(spark, {"dft": None, "mlip_risk": None})
    assert (failed.action, failed.reason, failed.purchased) == ("abstain", "DFT failed", ["mlip", "dft"])
    assert play(spark, mode="always_dft").purchased == ["dft"]
    assert play(spark, mode="always_high_level").purchased == ["high_level"]
    unseen = play(spark, {"high_level_value": None}, mode="always_high_level")
    assert (unseen.action, unseen.purchased, unseen.ran_high_level) == ("abstain", ["high_level"], True)
    closed = play(spark, {"high_level_supported": False, "mlip_risk": 0.9})
    assert (closed.action, closed.ran_high_level) == ("abstain", False)
    assert play(spark, {"mlip": None}).action == "abstain"


# ---- assembly ----------------------------------------------------------------

def assembly_inputs(spark, offset=0.0, **changes):
    base = dict(status="succeeded", energy_unit="hartree", cost=1.0, cost_unit="relative", settings_hash="s", force_count=2)
    rows = []
    for structure, energy in (("r", -1.0), ("ts", -0.99)):
        rec = {**base, **changes.get(structure, {})}
        e = energy + offset if rec["status"] == "succeeded" else None
        rows.append((structure, rec.get("hash", "h"), "d", rec["status"], e, rec["energy_unit"], rec["cost"], rec["cost_unit"], rec["settings_hash"], rec["force_count"]))
    calcs = spark.createDataFrame(rows, "structure_id string, geometry_hash string, method_id string, status string, energy double, energy_unit string, cost double, cost_unit string, settings_hash string, force_count int")
    structures = spark.createDataFrame([("r", "h", 2), ("ts", "h", 2)], "id string, geometry_hash string, atom_count int")
    terms = spark.createDataFrame([("o", 0, "r", -1.0), ("o", 1, "ts", 1.0)], "observable_id string, pos int, structure_id string, coefficient double")
    return terms, calcs, structures


def test_assembly(spark):
    want = 0.01 * EV_PER_HARTREE * KJ_MOL_PER_EV / KJ_PER_KCAL
    for offset in (0.0, 99.0):
        got = assemble_observables(*assembly_inputs(spark, offset), ["d"]).first()
        assert (got.value, got.cost, got.job_keys) == (pytest.approx(want, rel=1e-9), 2.0, ["h/d/s", "h/d/s"])
    reasons = {
        "unusable calculation r: failed": {"r": {"status": "failed"}, "ts": {"hash": "x"}},
        "geometry/state mismatch for ts": {"ts": {"hash": "x"}},
        "force atom count mismatch": {"ts": {"force_count": 3}},
        "mixed cost units or settings within one observable": {"ts": {"settings_hash": "z"}},
    }
    for reason, change in reasons.items():
        got = assemble_observables(*assembly_inputs(spark, **change), ["d"]).first()
        assert (got.value, got.failure_reason) == (None, reason)
    missing = assemble_observables(*assembly_inputs(spark), ["other"]).first()
    assert missing.failure_reason == "missing calculation r/other"
    with pytest.raises(ValueError):
        assemble_study(None, None, None, None, ["d"], "d")


def test_validation_reports_every_rule(spark):
    from tierlens.operators import validation as V

    df = spark.createDataFrame([("ok-1", 0.5), ("../x", 2.0), (None, float("nan"))], "name string, p double")
    found = V.validate_scalars(df, "name", id=V.identifier("name"), prob=V.probability("p")).collect()
    assert sorted((r.id or "", r.rule) for r in found) == [("", "id"), ("", "prob"), ("../x", "id"), ("../x", "prob")]
    with pytest.raises(V.ValidationError):
        V.require_clean(V.validate_scalars(df, "name", id=V.identifier("name")))
