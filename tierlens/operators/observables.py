"""Signed sums of per-species measurements, joined once for every method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import convert_energy, exact_sum
from ..plans.lineage import cut_lineage
from ..records import FEATURES, STAGE_DFT, AUXILIARY_FEATURES


def explode_terms(observables: DataFrame) -> DataFrame:
    """Nested ``terms`` -> one row per (observable, position)."""
    return observables.select(
        F.col("id").alias("observable_id"), F.posexplode("terms").alias("pos", "_t")
    ).select("observable_id", "pos", "_t.structure_id", "_t.coefficient")


def composition(structures: DataFrame) -> DataFrame:
    """Element counts per structure."""
    return (
        structures.select(F.col("id").alias("structure_id"), F.explode("symbols").alias("element"))
        .groupBy("structure_id", "element").agg(F.count("*").alias("count"))
    )


def balance_report(terms: DataFrame, structure_elements: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Net amount of each element (and of charge, as element ``charge``) per observable.

    ``structure_elements``: (structure_id, element, count).  A term without any row there is reported as
    element ``missing structure``.
    """
    # shuffled as they are: few terms of an observable share an element, and the task that makes the terms sums none
    joined = terms.join(structure_elements, "structure_id", "left").withColumn(
        "element", F.coalesce(F.col("element"), F.lit("missing structure"))).repartition("observable_id", "element")
    net = joined.groupBy("observable_id", "element").agg(
        F.sum(F.col("coefficient") * F.coalesce(F.col("count"), F.lit(0))).alias("net")
    )
    return net.withColumn(
        "balanced", (F.abs("net") <= tolerance) & (F.col("element") != "missing structure")
    )


def _per_structure(calculations: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per structure with a method -> record map (its size is the number of methods).

    ``found`` tells a missing record from one whose fields are NULL without reading them all.
    """
    optional = [c for c in ("force_count", "diagnostics", "fidelity") if c in calculations.columns]
    record = F.struct(
        F.lit(True).alias("found"),
        "status", "energy", "energy_unit", "geometry_hash", "cost", "cost_unit", "settings_hash", *optional
    )
    chosen = calculations.where(F.col("method_id").isin(list(methods)))
    return chosen.groupBy("structure_id").agg(
        F.map_from_entries(F.collect_list(F.struct("method_id", record))).alias("_by_method")
    )


def _expected_records(calculations: DataFrame, structures: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One written row per structure: what it must agree with and its record per method, ``rec_<number>``."""
    folded = structures.select(
        F.col("id").alias("structure_id"), F.col("geometry_hash").alias("_expected_hash"),
        (F.col("atom_count") if "atom_count" in structures.columns else F.lit(None).cast("int")).alias("_atoms"),
    ).join(_per_structure(calculations, methods), "structure_id", "left")
    return cut_lineage(folded.select(
        "structure_id", "_expected_hash", "_atoms",
        *[F.try_element_at("_by_method", F.lit(m)).alias(f"rec_{i}") for i, m in enumerate(methods)]))


def term_records(terms: DataFrame, calculations: DataFrame, structures: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(observable, position, method) with its calculation record ``rec`` (NULL if missing).

    The calculation side is folded to one row per structure and written first, so terms are shuffled once however
    many methods there are, and a structure used by a large share of all terms is a join of two plain shuffles
    that AQE splits on the term side.
    """
    joined = terms.join(_expected_records(calculations, structures, methods), "structure_id", "left")
    wanted = F.explode(F.array(*[
        F.struct(F.lit(m).alias("method_id"), F.col(f"rec_{i}").alias("rec")) for i, m in enumerate(methods)])).alias("_m")
    return joined.select("*", wanted).select(
        *[c for c in joined.columns if not c.startswith("rec_")], "_m.method_id", "_m.rec")


def _term_problem(rec: Column, method: str, has_forces: bool) -> Column:
    """First thing wrong with one term under one method, in the order the checks apply."""
    out = (
        F.when(rec["found"].isNull(), F.concat(F.lit("missing calculation "), F.col("structure_id"), F.lit(f"/{method}")))
        .when(rec["status"] != "succeeded",
              F.concat(F.lit("unusable calculation "), F.col("structure_id"), F.lit(": "), rec["status"]))
        .when(~rec["geometry_hash"].eqNullSafe(F.col("_expected_hash")),
              F.concat(F.lit("geometry/state mismatch for "), F.col("structure_id")))
    )
    if has_forces:
        out = out.when(rec["force_count"].isNotNull() & (rec["force_count"] != F.col("_atoms")),
                       F.lit("force atom count mismatch"))
    return out


def _method_terms(
    terms: DataFrame, expected: DataFrame, methods: Sequence[str], unit: str, diagnostics: Sequence[str] = (),
) -> DataFrame:
    """(observable, position, method) with what assembly needs to know of the term.

    A term crosses the network once, next to the other terms of its observable, with plain columns per method of which
    unread ones are pruned; only there does it become one row per method.  A geometry hash is carried once, a record's
    own only if it differs.
    """
    names = expected.schema["rec_0"].dataType.names
    facts = {}
    for i, m in enumerate(methods):
        rec = F.col(f"rec_{i}")
        same = rec["geometry_hash"].eqNullSafe(F.col("_expected_hash"))
        facts[m] = {
            "_problem": _term_problem(rec, m, "force_count" in names),
            "_energy": convert_energy(rec["energy"], rec["energy_unit"], F.lit(unit)),
            "_found": rec["found"], "_same": same, "_other_hash": F.when(~same, rec["geometry_hash"]),
            "_cost": rec["cost"], "_cost_unit": rec["cost_unit"], "_settings": rec["settings_hash"],
        }
        for name in diagnostics:
            value = rec["diagnostics"][name] if "diagnostics" in names else F.lit(None).cast("double")
            facts[m][name] = F.when(rec["status"] == "succeeded", value)
    joined = terms.join(expected, "structure_id", "left").select(
        "observable_id", "pos", "structure_id", "coefficient", "_expected_hash",
        *[c.alias(f"{n}_{i}") for i, of in enumerate(facts.values()) for n, c in of.items()])
    per_method = joined.repartition("observable_id").withColumn("method_id", F.explode(F.array(*[F.lit(m) for m in methods])))

    def mine(name: str) -> Column:
        out = F.lit(None)
        for i, m in enumerate(methods):
            out = F.when(F.col("method_id") == m, F.col(f"{name}_{i}")).otherwise(out)
        return out.alias(name)

    known = per_method.select(
        "observable_id", "pos", "structure_id", "coefficient", "method_id", "_expected_hash", *[mine(n) for n in facts[methods[0]]])
    return known.withColumn("_hash", F.when(F.col("_same"), F.col("_expected_hash")).otherwise(F.col("_other_hash")))


def assemble_observables(
    terms: DataFrame, calculations: DataFrame, structures: DataFrame, methods: Sequence[str],
    unit: str = "kcal/mol",
) -> DataFrame:
    """One row per (observable, method): value, cost and job keys, or the first failure reason."""
    return _assemble(_method_terms(terms, _expected_records(calculations, structures, methods), methods, unit), unit)


def _assemble(method_terms: DataFrame, unit: str, extra: Sequence[Column] = ()) -> DataFrame:
    parts = method_terms.withColumns({
        "_value": F.col("coefficient") * F.col("_energy"), "_key": F.concat_ws("/", "_hash", "method_id", "_settings")})
    # An observable is one input record, so its term list is bounded by that record.  Keys are a list of their own, which
    # is not built where no one reads it.
    grouped = parts.groupBy("observable_id", "method_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "_value"))).alias("_values"),
        F.array_sort(F.collect_list(F.struct("pos", "_value", "_key"))).alias("_keys"),
        F.min(F.when(F.col("_problem").isNotNull(), F.struct("pos", "_problem")))["_problem"].alias("_problem"),
        exact_sum("_cost").alias("_cost"),
        F.min("_cost_unit").alias("_unit_lo"), F.max("_cost_unit").alias("_unit_hi"),
        F.min("_settings").alias("_set_lo"), F.max("_settings").alias("_set_hi"),
        *extra,
    )
    mixed = (F.col("_unit_lo") != F.col("_unit_hi")) | (F.col("_set_lo") != F.col("_set_hi"))
    reason = F.coalesce(
        F.col("_problem"), F.when(mixed, F.lit("mixed cost units or settings within one observable"))
    )
    good = reason.isNull()
    total = F.aggregate("_values", F.lit(0.0), lambda acc, t: acc + t["_value"])
    return grouped.select(
        "observable_id", "method_id",
        F.when(good, total).alias("value"),
        F.lit(unit).alias("unit"),
        F.when(good, F.transform("_keys", lambda t: t["_key"])).alias("job_keys"),
        F.when(good, F.col("_cost")).alias("cost"),
        F.when(good, F.col("_unit_lo")).alias("cost_unit"),
        reason.alias("failure_reason"),
        *[c for c in grouped.columns if c.startswith("x_")],
    )


def ensemble_std(assembled: DataFrame) -> DataFrame:
    """Sample standard deviation of one observable over its methods; NULL below two members."""
    return assembled.where(F.col("value").isNotNull()).groupBy("observable_id").agg(
        F.count("*").alias("members"), F.stddev_samp("value").alias("ensemble_std")
    )


# ---- guards (each returns a violation table) ---------------------------------

def check_method_names(mlip_methods: Sequence[str], dft_method: str, high_level_method: str | None) -> None:
    named = [*mlip_methods, dft_method, *([high_level_method] if high_level_method else [])]
    if not mlip_methods or len(set(named)) != len(named):
        raise ValueError("every fidelity needs its own, distinct method ids")


def method_guards(
    calculations: DataFrame, mlip_methods: Sequence[str], dft_method: str, high_level_method: str | None = None,
) -> DataFrame:
    """Rule name and number of offending records: duplicate keys, wrong fidelity, mixed cost units."""
    check_method_names(mlip_methods, dft_method, high_level_method)
    role = F.when(F.col("method_id").isin(list(mlip_methods)), "mlip").when(F.col("method_id") == dft_method, "dft")
    if high_level_method:
        role = role.when(F.col("method_id") == high_level_method, "high_level")
    repeated = calculations.groupBy("structure_id", "method_id").agg(F.count("*").alias("n"))
    return (
        repeated.agg(F.lit("duplicate_calculation").alias("rule"),
                     F.count(F.when(F.col("n") > 1, 1)).alias("violations"))
        .unionByName(calculations.agg(
            F.lit("fidelity_mismatch").alias("rule"),
            F.count(F.when(role.isNotNull() & (F.col("fidelity") != role), 1)).alias("violations")))
        .unionByName(calculations.agg(
            F.lit("mixed_cost_units").alias("rule"),
            (F.count_distinct("cost_unit") - 1).alias("violations")))
    )


def teacher_match(calculations: DataFrame, mlip_methods: Sequence[str], dft_method: str) -> DataFrame:
    """One row: whether all records share one known teacher and every teacher record is verified."""
    mine = calculations.where(F.col("method_id").isin([*mlip_methods, dft_method]))
    is_dft = F.col("method_id") == dft_method
    facts = mine.agg(
        F.count(F.when(~is_dft, 1)).alias("mlip_records"), F.count(F.when(is_dft, 1)).alias("dft_records"),
        F.count_distinct("teacher_id").alias("teachers"),
        F.count(F.when(F.col("teacher_id").isNull(), 1)).alias("unnamed"),
        F.count(F.when(is_dft & ~F.coalesce("teacher_verified", F.lit(False)), 1)).alias("unverified"),
    )
    ok = (F.col("mlip_records") > 0) & (F.col("dft_records") > 0) & (F.col("teachers") == 1) & (
        F.col("unnamed") == 0) & (F.col("unverified") == 0)
    return facts.withColumn("matched", ok)


def shared_cost_conflicts(rows: DataFrame) -> DataFrame:
    """Operation keys that appear with more than one cost anywhere in a study table."""
    ops = rows.select(F.explode("operations").alias("stage", "ops")).select(F.explode("ops").alias("operation", "cost"))
    return ops.groupBy("operation").agg(
        F.min("cost").alias("lowest"), F.max("cost").alias("highest"), F.count("*").alias("uses")
    ).where(F.col("lowest") != F.col("highest"))


def decision_group_leaks(rows: DataFrame) -> DataFrame:
    """Decision groups that cross a split group."""
    return rows.where(F.col("decision_group").isNotNull()).groupBy("decision_group").agg(
        F.min("group_id").alias("first_group"), F.max("group_id").alias("last_group")
    ).where(F.col("first_group") != F.col("last_group"))


# ---- the wide study table ----------------------------------------------------

CARRIED = ("duplicate_of", "metadata", "ord")


def assemble_study(
    observables: DataFrame, terms: DataFrame, calculations: DataFrame, structures: DataFrame,
    mlip_methods: Sequence[str], dft_method: str, high_level_method: str | None = None,
    high_level_cost: float = 20.0, require_teacher: bool = False,
) -> DataFrame:
    """One study row per observable; failed calculations stay as NULL with their reasons.

    The first surrogate method is the primary one and is never swapped.  The ensemble spread exists only if
    *every* one of at least two members succeeded, a diagnostic only if every species reports it.  What an
    observable carries of ``duplicate_of``, ``metadata`` and ``ord`` goes on into its study row; with
    ``require_teacher`` the surrogate and teacher records must share one verified teacher.
    """
    check_method_names(mlip_methods, dft_method, high_level_method)
    if require_teacher and not teacher_match(calculations, mlip_methods, dft_method).first()["matched"]:
        raise ValueError("surrogate and teacher records do not share one verified teacher")
    if high_level_cost < 0:
        raise ValueError("high_level_cost must be non-negative")
    methods = [*mlip_methods, dft_method, *([high_level_method] if high_level_method else [])]
    direct = [n for n, f in FEATURES.items() if f.stage == STAGE_DFT and n not in AUXILIARY_FEATURES]
    expected = _expected_records(calculations, structures, methods)
    operation = F.concat_ws("/", "structure_id", "_hash", "method_id", "_settings")
    extra = [
        F.collect_set(F.when(F.col("_found"), F.struct(operation.alias("key"), F.col("_cost").alias("value")))).alias("x_ops"),
    ]
    for name in direct:
        extreme = F.min(name) if name == "homo_lumo_gap_ev" else F.max(name)
        extra.append(F.when(F.count(name) == F.count("*"), extreme).alias(f"x_{name}"))
    long = _assemble(_method_terms(terms, expected, methods, "kcal/mol", direct), "kcal/mol", extra)

    def of(method: str, column: str) -> Column:
        return F.max(F.when(F.col("method_id") == method, F.col(column)))

    surrogate = F.col("method_id").isin(list(mlip_methods))
    all_ok = (F.count(F.when(surrogate, F.col("value"))) == len(mlip_methods)) & F.lit(len(mlip_methods) >= 2)
    stage_of = {"mlip": list(mlip_methods), "dft": [dft_method],
                "high_level": [high_level_method] if high_level_method else []}
    wide = long.groupBy("observable_id").agg(
        of(mlip_methods[0], "value").alias("mlip"),
        of(dft_method, "value").alias("dft"),
        (of(high_level_method, "value") if high_level_method else F.lit(None).cast("double")).alias("high_level_value"),
        F.when(all_ok, F.stddev_samp(F.when(surrogate, F.col("value")))).alias("ensemble_std"),
        *[of(dft_method, f"x_{n}").alias(n) for n in direct],
        *[F.flatten(F.collect_list(F.when(F.col("method_id").isin(ms), F.col("x_ops")))).alias(f"_ops_{stage}")
          for stage, ms in stage_of.items() if ms],
        F.array_sort(F.collect_list(F.when(F.col("failure_reason").isNotNull(),
                     F.struct(F.col("method_id").alias("method"), F.col("failure_reason").alias("reason"))))).alias("failures"),
    )
    entries = []
    costs = []
    for stage, ms in stage_of.items():
        if not ms:
            costs += [F.lit(stage), F.lit(float(high_level_cost) if stage == "high_level" else 0.0)]
            continue
        ops = F.map_from_entries(F.array_sort(f"_ops_{stage}"))
        entries.append(F.when(F.size(f"_ops_{stage}") > 0, F.struct(F.lit(stage).alias("key"), ops.alias("value"))))
        paid = F.aggregate(F.array_sort(f"_ops_{stage}"), F.lit(0.0), lambda a, o: a + o["value"])
        costs += [F.lit(stage), paid]
    ref = F.col("reference")
    unknown = F.lit(None).cast("double")
    stage2 = []
    for name, feature in FEATURES.items():
        if feature.stage == STAGE_DFT:
            stage2 += [F.lit(name), unknown if name in AUXILIARY_FEATURES else F.col(name)]
    return observables.join(wide, observables["id"] == wide["observable_id"], "left").select(
        "id", "group_id", "mlip", "dft",
        convert_energy(ref["value"], ref["unit"], F.lit("kcal/mol")).alias("reference"),
        F.create_map(F.lit("ensemble_std"), F.col("ensemble_std")).alias("mlip_features"),
        F.create_map(*stage2).alias("dft_features"),
        F.create_map(*costs, F.lit("screen"), F.lit(0.0), F.lit("diagnostics"), F.lit(0.0)).alias("costs"),
        F.coalesce(ref["quality"], F.lit("unreviewed")).alias("reference_quality"),
        convert_energy(ref["uncertainty"], ref["unit"], F.lit("kcal/mol")).alias("reference_uncertainty"),
        "high_level_value",
        F.lit(high_level_method is not None).alias("high_level_supported"),
        "decision_group",
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("operations"),
        "failures",
        ref["source"].alias("reference_source"), ref["method"].alias("reference_method"),
        *[observables[c] for c in CARRIED if c in observables.columns],
    )
