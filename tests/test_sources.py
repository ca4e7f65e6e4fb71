"""Readers on small files and fabricated texts."""

import json

import pytest
from pyspark.sql import functions as F

from tierlens.operators import jobs, validation
from tierlens.sources import datasets, geometries, reactions, run_logs, text

LOG = """Program Version 6.1.0
SCF CONVERGED AFTER 12 CYCLES
Expectation value of <S**2> : 0.8000
HOMO-LUMO GAP: 2.5 eV
FINAL SINGLE POINT ENERGY -1.123456789
ORCA TERMINATED NORMALLY
"""
ORBITALS = """ORBITAL ENERGIES
  NO   OCC          E(Eh)            E(eV)
   0   1.0000      -0.500000       -13.6057
   1   1.0000      -0.100000        -2.7211
   2   0.0000       0.200000         5.4423

  NO   OCC          E(Eh)            E(eV)
   0   1.0000      -0.500000       -13.6057
   1   0.0000       0.300000         8.1634
*Only
   3   0.0000       0.000000         0.0000
"""


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "path string, text string")


def test_status_ladder(spark):
    logs = {
        "ok": LOG, "no end": LOG.replace("ORCA TERMINATED NORMALLY", ""), "scf": LOG + "SCF NOT CONVERGED\n",
        "error": LOG + "ORCA finished by error termination\n", "two": LOG + "FINAL SINGLE POINT ENERGY -2.0\n",
        "unconfirmed": LOG.replace("SCF CONVERGED AFTER 12 CYCLES\n", ""), "twice": LOG + LOG,
    }
    df = spark.createDataFrame([(k, v, 2) for k, v in logs.items()], "path string, text string, multiplicity int")
    got = {r.path: r for r in run_logs.extract_run_logs(df).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "ok": "succeeded", "no end": "failed", "scf": "nonconverged", "error": "failed", "two": "unsupported",
        "unconfirmed": "nonconverged", "twice": "failed"}
    ok = got["ok"]
    assert (ok.energy_hartree, ok.software_version, ok.scf_cycles, ok.homo_lumo_gap_ev) == (-1.123456789, "6.1.0", 12.0, 2.5)
    assert ok.spin_contamination == pytest.approx(0.05) and all(r.energy_hartree is None for k, r in got.items() if k != "ok")


def test_orbital_table(spark):
    cases = [("gap", ORBITALS), ("fraction", ORBITALS.replace("1   1.0000", "1   0.5000")), ("smear", ORBITALS + "SMEARTEMP"), ("two", ORBITALS + ORBITALS), ("none", LOG)]
    got = {r.path: r.g for r in frame(spark, cases).select("path", run_logs.orbital_table_gap("text").alias("g")).collect()}
    assert got["gap"] == pytest.approx(8.1634) and [got[k] for k in ("fraction", "smear", "two", "none")] == [None] * 4


def test_xyz_and_coord(spark):
    xyz = [("a", "2\ncomment\nH 0 0 0\nH 0 0 0.74"), ("d", "1\nc\nH 1.0D-1 0 0\n\n"), ("short", "1\n"), ("frames", "1\nc\nH 0 0 0\n1\nc\nH 0 0 0"),
           ("cols", "1\nc\nH 0 0"), ("word", "1\nc\nH 0 0 x"), ("count", "x\nc\nH 0 0 0")]
    got = {r.path: r for r in geometries.parse_xyz(frame(spark, xyz)).collect()}
    assert got["a"].symbols == ["H", "H"] and got["a"].positions_angstrom[1] == [0.0, 0.0, 0.74] and got["d"].positions_angstrom == [[0.1, 0.0, 0.0]]
    assert all(got[k].problem and got[k].symbols is None for k in ("short", "frames", "cols", "word", "count"))
    coord = [("b", "$coord\n0 0 0 h\n0 0 1.4 cl\n$end"), ("a", "$coord angs\n0 0 1 h\n$user\n1 1 1 h"), ("unit", "$coord frac\n0 0 0 h\n$end"), ("none", "x")]
    got = {r.path: r for r in geometries.parse_coord_block(frame(spark, coord)).collect()}
    assert got["b"].symbols == ["H", "Cl"] and got["b"].positions_angstrom[1][2] == pytest.approx(1.4 * 0.529177210903)
    assert got["a"].positions_angstrom == [[0.0, 0.0, 1.0]] and got["unit"].problem and got["none"].problem
    back = spark.createDataFrame([("m", ["H"], [[0.0, 0.5, 1.0]], 0, 2)], "id string, symbols array<string>, positions_angstrom array<array<double>>, charge int, multiplicity int")
    assert geometries.render_xyz(back).first().text == "1\nm charge=0 multiplicity=2\nH 0.0 0.5 1.0\n"


def test_interpolation_guards(spark):
    s = "struct<symbols:array<string>,positions_angstrom:array<array<double>>,charge:int,multiplicity:int>"
    far, near = [[0.0, 0.0, 0.0], [0.0, 0.0, 2.0]], [[0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    flip = [[0.0, 0.0, 2.0], [0.0, 0.0, 0.0]]
    rows = [("ok", (["H", "H"], far, 0, 1), (["H", "H"], near, 0, 1), True), ("hit", (["H", "H"], far, 0, 1), (["H", "H"], flip, 0, 1), True),
            ("other", (["H", "H"], far, 0, 1), (["H", "O"], near, 0, 1), True), ("unsure", (["H", "H"], far, 0, 1), (["H", "H"], near, 0, 1), False)]
    out = geometries.interpolate_pairs(spark.createDataFrame(rows, f"pair_id string, start {s}, end {s}, mapping_verified boolean"), images=3).collect()
    by = {(r.pair_id, r.image): r for r in out}
    assert by["ok", 1].positions_angstrom[1][2] == pytest.approx(1.5) and by["hit", 1].problem and not by["hit", 0].problem
    assert by["other", 0].problem and by["unsure", 2].problem


def test_reaction_grammar(spark):
    good = "$tmer r/$f ts/$f x -1 1 $w 2.0 # comment"
    lines = ["preamble; rm -rf", good, good, "${tmer} a/${f} b/$f a/$f x 1 1 1 ${w} 3", "$tmer a/$f x 1 $w 1", "$tmer ../a/$f b/$f x 1 -1 $w 1",
             "$tmer a/$f b/$f x 1 $w 1", "$tmer a/$f b/$f x 1 q $w 1", "$tmer $(id)/$f b/$f x 1 -1 $w 1", "$tmer 'a/$f' b/$f x 1 -1 $w 1"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")
    got = {r.line: r for r in reactions.parse_reaction_lines(df).collect()}
    assert 1 not in got and got[2].reference == 2.0 and [tuple(t) for t in got[2].terms] == [("r", -1.0), ("ts", 1.0)]
    assert [tuple(t) for t in got[4].terms] == [("a", 2.0), ("b", 1.0)]
    assert all(got[k].problem and got[k].terms is None for k in range(5, 11))
    obs = {r.id: r for r in reactions.reaction_observables(reactions.parse_reaction_lines(df), "S").collect()}
    # observables are numbered by data row: the preamble has no number
    assert obs["S:001"].duplicate_of is None and obs["S:002"].duplicate_of == "S:001" and obs["S:001"].group_id == obs["S:002"].group_id
    assert sorted(obs) == ["S:001", "S:002", "S:003"]


def test_hidden_side_files(spark, tmp_path):
    (tmp_path / ".CHRG").write_text("-1\n")
    paths = spark.createDataFrame([(str(tmp_path / ".CHRG"),), (str(tmp_path / ".UHF"),)], "path string")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in text.read_listed_files(paths).collect()}
    assert got == {".CHRG": "-1\n", ".UHF": None}
    geo = spark.createDataFrame([("a",), ("b",)], "species string")
    cars = spark.createDataFrame([("a", ".CHRG", "-1\n"), ("a", ".UHF", "2")], "species string, name string, text string")
    assert sorted(tuple(r)[:3] for r in reactions.attach_sidecars(geo, cars).collect()) == [("a", -1, 3), ("b", 0, 1)]


def test_gradients(spark):
    df = spark.createDataFrame([("g", "# n\n1\n# e\n-1.0\n# g\n1.0\n0.0\n-2.0D0\n", 1), ("bad", "2\n-1\n1\n", 2)], "path string, text string, atom_count int")
    got = {r.path: r for r in run_logs.extract_gradients(df).collect()}
    assert got["g"].forces_ev_angstrom[0] == pytest.approx([-51.42206747632, 0.0, 102.84413495264]) and got["bad"].gradient_problem


def dataset_doc():
    term = lambda s, c: {"structure_id": s, "coefficient": c}
    h2 = lambda i, z: {"id": i, "symbols": ["H", "H"], "positions_angstrom": [[0, 0, 0], [0, 0, z]], "charge": 0, "multiplicity": 1, "source": "test"}
    return {"schema_version": "1.0", "name": "h2", "metadata": {}, "structures": [h2("h2-r", 0.74), h2("h2-ts", 1.2)], "observables": [
        {"id": "barrier1", "group_id": "family1", "kind": "relative_energy", "terms": [term("h2-r", -1), term("h2-ts", 1)],
         "reference": None, "decision_group": None, "metadata": {"k": [1, 2]}}]}


def test_dataset_json(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(dataset_doc()))
    structures, observables = datasets.load_dataset(spark, str(path))
    assert structures.count() == 2 and observables.first().reference is None and len(observables.first().terms) == 2
    assert structures.orderBy("id").first().positions_angstrom[1] == [0.0, 0.0, 0.74]
    assert not any(r.violations for r in datasets.dataset_violations(structures, observables).collect())
    for bad in ('{"schema_version":"1.0","a":1,"a":2}', '{"schema_version":"1.0","a":NaN}', '{"schema_version":"2.0"}'):
        path.write_text(bad)
        with pytest.raises(Exception):
            datasets.read_documents(spark, str(path)).collect()


def test_calculation_and_attachment_json(spark, tmp_path):
    calc = {"structure_id": "h2-r", "geometry_hash": "a" * 64, "method_id": "dft-a", "fidelity": "dft", "status": "succeeded", "energy": -1.0,
            "energy_unit": "hartree", "diagnostics": {"scf_cycles": 5}, "cost": 1.0, "cost_unit": "relative", "forces_ev_angstrom": [[0, 0, 1]], "provenance": {}}
    for i in (1, 2):
        (tmp_path / f"c{i}.json").write_text(json.dumps({"schema_version": "1.0", "calculations": [{**calc, "method_id": f"m{i}"}, {**calc, "method_id": "both"}]}))
    got = datasets.load_calculations(spark, str(tmp_path / "c*.json"))
    assert got.count() == 4 and got.first().diagnostics == {"scf_cycles": 5.0}
    assert [tuple(r) for r in validation.duplicate_keys(got, "structure_id", "method_id").collect()] == [("h2-r", "both", 2)]
    assert validation.validate_calculations(got.where("method_id = 'm1'").withColumn("wall_seconds", F.lit(0.0))).count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"row_id": "a", "stage": "diagnostics", "features": {"fod": 1.5}, "operations": {"fod-job": 8.0},
                                                  "provenance": {"method": "m", "source_sha256": "0" * 64}}]))
    item = datasets.load_records(spark, str(tmp_path / "a.json"), "attachment").first()
    assert item.features == {"fod": 1.5} and item.provenance.method == "m"
    row = {"id": "a", "group_id": "g", "mlip": 5.0, "dft": None, "mlip_features": {"ensemble_std": 0.1}, "operations": {"dft": {"x": 1.0}}, "high_level_supported": True}
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": "1.0", "rows": [row]}))
    loaded = datasets.load_study_table(spark, str(tmp_path / "t.json")).first()
    assert (loaded.mlip, loaded.dft, loaded.operations) == (5.0, None, {"dft": {"x": 1.0}})


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    datasets.save_table(df, str(tmp_path / "t"))
    assert datasets.load_table(spark, str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception):
        datasets.save_table(df, str(tmp_path / "t"))
    (tmp_path / "m.csv").write_text("system_id,charge\nx,0\n")
    with pytest.raises(ValueError):
        datasets.scan_manifest(spark, str(tmp_path / "m.csv"))
    manifest = datasets.file_manifest(spark, str(tmp_path / "m.csv")).first()
    import hashlib
    assert manifest.sha256 == hashlib.sha256(b"system_id,charge\nx,0\n").hexdigest()


def test_import_keeps_missing_jobs(spark):
    structures = spark.createDataFrame([("s", ["H"], [[0.0, 0.0, 0.0]], 0, 2, "t")], "id string, symbols array<string>, positions_angstrom array<array<double>>, charge int, multiplicity int, source string")
    plan = jobs.plan_jobs(structures, [{"method_id": "a", "fidelity": "dft"}, {"method_id": "b", "fidelity": "dft"}])
    assert jobs.verify_plan(plan).count() == 0 and plan.select("job_id").distinct().count() == 2
    logs = plan.where(F.col("config.method_id") == "a").select("job_id", F.lit(LOG).alias("text"))
    got = {r.method_id: r for r in jobs.import_results(plan, logs).collect()}
    assert got["a"].energy == -1.123456789 and (got["b"].status, got["b"].message) == ("failed", "output missing")


def test_table_manifest_names_the_changed_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 900, 1, 3).selectExpr("id", "cast(id % 7 as string) as s").write.parquet(path)
    before = {r.path: (r.rows, r.fingerprint) for r in datasets.table_manifest(spark.read.parquet(path)).collect()}
    assert len(before) == 3 and sum(n for n, _ in before.values()) == 900
    again = datasets.table_manifest(spark.read.parquet(path)).collect()
    assert {r.path: (r.rows, r.fingerprint) for r in again} == before
    spark.range(5).selectExpr("id", "'x' as s").write.mode("append").parquet(path)
    after = {r.path: (r.rows, r.fingerprint) for r in datasets.table_manifest(spark.read.parquet(path)).collect()}
    assert all(after[p] == mark for p, mark in before.items()) and len(after) > 3
