"""Record rules as violation tables: (id, rule) rows instead of an exception at the first bad record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, col, finite, is_true
from ..records import (
    CALC_STATUSES, COST_STAGES, ELEMENT_SYMBOLS, EV_PER_UNIT, FIDELITIES, IDENTIFIER_PATTERN, OBSERVABLE_KINDS,
    REFERENCE_QUALITIES, STAGE_1_FEATURES, STAGE_2_FEATURES,
)


class ValidationError(ValueError):
    """Raised by :func:`require_clean`."""


def broken_rules(df: DataFrame, row_id, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule whose condition is not surely true."""
    hits = F.array_compact(F.array(*[F.when(~is_true(ok), F.lit(name)) for name, ok in rules.items()]))
    return df.select(col(row_id).alias("id"), F.explode(hits).alias("rule"))


def require_clean(violations: DataFrame, sample: int = 5) -> None:
    """Fail fast: raise with a few examples if the table is not empty."""
    found = violations.limit(sample).collect()
    if found:
        raise ValidationError("; ".join(str(r.asDict()) for r in found))


def guard(ok: Column, value: Column, message: str) -> Column:
    """``value``, or a failed query where the rule is not met."""
    return F.when(is_true(ok), value).otherwise(F.raise_error(F.lit(message)))


# ---- scalars and vectors -----------------------------------------------------

def nonnegative(c) -> Column:
    return finite(c) & (col(c) >= 0)


def positive(c) -> Column:
    return finite(c) & (col(c) > 0)


def probability(c) -> Column:
    return finite(c) & (col(c) >= 0) & (col(c) <= 1)


def integer_at_least(c, minimum: int) -> Column:
    return finite(col(c).cast("double")) & (col(c) == F.floor(c)) & (col(c) >= minimum)


def identifier(c) -> Column:
    return col(c).rlike(IDENTIFIER_PATTERN) & ~col(c).contains("..") & ~col(c).contains("//")


def optional(c, ok: Column) -> Column:
    return col(c).isNull() | ok


def vector(c) -> Column:
    return (F.size(c) > 0) & F.forall(c, finite)


def matrix(c) -> Column:
    rows = col(c)
    return (F.size(rows) > 0) & F.forall(rows, lambda r: vector(r) & (F.size(r) == F.size(rows[0])))


def validate_scalars(df: DataFrame, row_id, **rules: Column) -> DataFrame:
    return broken_rules(df, row_id, rules)


# ---- records -----------------------------------------------------------------

def _atomic_number(symbol: Column) -> Column:
    """118-entry literal lookup: 0 (from array_position) for an unknown symbol."""
    return F.array_position(F.lit(ELEMENT_SYMBOLS), symbol)


def validate_structures(structures: DataFrame) -> DataFrame:
    atoms = F.transform("symbols", _atomic_number)
    electrons = F.aggregate(atoms, F.lit(0).cast("long"), lambda a, z: a + z) - F.col("charge")
    unpaired = F.col("multiplicity") - 1
    places = F.col("positions_angstrom")
    return broken_rules(structures, "id", {
        "identifier": identifier("id"),
        "multiplicity": F.col("multiplicity") >= 1,
        "source": F.length("source") > 0,
        "elements": (F.size("symbols") > 0) & F.forall(atoms, lambda z: z > 0),
        "shape": (F.size(places) == F.size("symbols")) & F.forall(places, lambda p: (F.size(p) == 3) & F.forall(p, finite)),
        "coincident_nuclei": F.size(F.array_distinct(places)) == F.size(places),
        "electron_count": (electrons >= 0) & (unpaired <= electrons) & (F.pmod(electrons - unpaired, F.lit(2)) == 0),
    })


def validate_observables(observables: DataFrame) -> DataFrame:
    terms = F.col("terms")
    return broken_rules(observables, "id", {
        "identifier": identifier("id"),
        "group": identifier("group_id"),
        "kind": F.col("kind").isin(*OBSERVABLE_KINDS),
        "unique_terms": (F.size(terms) >= 2) & (F.size(F.array_distinct(F.transform(terms, lambda t: t["structure_id"]))) == F.size(terms)),
        "nonzero_coefficients": F.forall(terms, lambda t: finite(t["coefficient"]) & (t["coefficient"] != 0)),
        "both_signs": F.exists(terms, lambda t: t["coefficient"] > 0) & F.exists(terms, lambda t: t["coefficient"] < 0),
        "decision_group": optional("decision_group", identifier("decision_group")),
    })


def validate_references(observables: DataFrame) -> DataFrame:
    """Rules of the optional ``reference`` struct; observables without one pass."""
    ref = F.col("reference")
    return broken_rules(observables.where(ref.isNotNull()), "id", {
        "value": finite(ref["value"]),
        "unit": ref["unit"].isin(*EV_PER_UNIT),
        "method_and_source": (F.length(ref["method"]) > 0) & (F.length(ref["source"]) > 0),
        "quality": ref["quality"].isin(*REFERENCE_QUALITIES),
        "uncertainty": optional(ref["uncertainty"], nonnegative(ref["uncertainty"])),
        "review_note": (ref["quality"] != "reviewed") | (F.length(F.trim(ref["review_note"])) > 0),
    })


def validate_calculations(calculations: DataFrame) -> DataFrame:
    rules = {
        "identifier": identifier("structure_id") & identifier("method_id"),
        "fidelity": F.col("fidelity").isin(*FIDELITIES),
        "status": F.col("status").isin(*CALC_STATUSES),
        "energy_unit": F.col("energy_unit").isin(*EV_PER_UNIT),
        "geometry_hash": F.col("geometry_hash").rlike("^[0-9a-f]{64}$"),
        "energy_iff_succeeded": (F.col("status") == "succeeded") == F.col("energy").isNotNull(),
        "energy_finite": optional("energy", finite("energy")),
        "cost": nonnegative("cost"),
        "cost_unit": F.length("cost_unit") > 0,
    }
    if "wall_seconds" in calculations.columns:
        rules["wall_seconds"] = nonnegative("wall_seconds")
    if "diagnostics" in calculations.columns:
        rules["diagnostics"] = F.col("diagnostics").isNull() | F.forall(
            F.map_values("diagnostics"), lambda v: v.isNull() | finite(v))
    if "forces_ev_angstrom" in calculations.columns:
        forces = F.col("forces_ev_angstrom")
        rules["forces"] = forces.isNull() | (
            (F.size(forces) > 0) & F.forall(forces, lambda f: (F.size(f) == 3) & F.forall(f, finite)))
    key = F.concat_ws("/", "structure_id", "method_id")
    return broken_rules(calculations, key, rules)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def validate_pairs(df: DataFrame, row_id, label: str, score: str, probabilities: bool = False) -> DataFrame:
    """Precondition of every ranking metric: labels 0/1, finite scores (in [0, 1] on request)."""
    rules = {"binary_label": F.col(label).isin(0, 1), "finite_score": finite(score)}
    if probabilities:
        rules["probability"] = probability(score)
    return broken_rules(df, row_id, rules)


def validate_study_rows(rows: DataFrame) -> DataFrame:
    ones, twos = F.col("mlip_features"), F.col("dft_features")
    known = lambda m: F.forall(F.map_values(m), lambda v: v.isNull() | finite(v))
    itemised = F.forall(F.map_entries("operations"), lambda e: all_of(
        e["key"].isin(*COST_STAGES), F.size(e["value"]) > 0,
        F.forall(F.map_values(e["value"]), lambda v: nonnegative(v)),
        F.abs(F.aggregate(F.map_values(e["value"]), F.lit(0.0), lambda a, v: a + v)
              - F.try_element_at("costs", e["key"])) <= 1e-8))
    values = {n: optional(n, finite(n)) for n in ("mlip", "dft", "reference", "high_level_value")}
    return broken_rules(rows, "id", {
        "identifier": identifier(F.col("id").cast("string")) & identifier(F.col("group_id").cast("string")),
        "finite_values": all_of(*values.values()),
        "quality": F.col("reference_quality").isin(*REFERENCE_QUALITIES),
        "uncertainty": optional("reference_uncertainty", nonnegative("reference_uncertainty")),
        "features_finite": known(ones) & known(twos),
        "stage_1_names": F.forall(F.map_keys(ones), lambda k: k.isin(*STAGE_1_FEATURES)),
        "stage_2_names": F.forall(F.map_keys(twos), lambda k: k.isin(*STAGE_2_FEATURES)),
        "features_disjoint": ~F.arrays_overlap(F.map_keys(ones), F.map_keys(twos)),
        "cheap_screen": F.try_element_at(ones, F.lit("cheap_screen")).isNull() | probability(F.try_element_at(ones, F.lit("cheap_screen"))),
        "cost_stages": F.array_sort(F.map_keys("costs")) == F.array_sort(F.lit(list(COST_STAGES))),
        "costs": F.forall(F.map_values("costs"), lambda v: nonnegative(v)),
        "operations": itemised,
        "high_level_supported": F.col("high_level_supported").isNotNull(),
    })
