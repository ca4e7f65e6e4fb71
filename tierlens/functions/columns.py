"""Column functions: every one is a pure expression that stays inside the scan stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..records import EV_PER_UNIT

INFINITY = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_true(condition: Column) -> Column:
    """Three-valued condition folded to a plain boolean: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def settle(df: DataFrame, keep=()) -> DataFrame:
    """Evaluate the columns here, once per row (``keep``: plain input columns that need no such fence).

    Without it a filter on a deeply derived column is pushed down as one expression that repeats every step
    it was built from.
    """
    derived = [c for c in df.columns if c not in keep]
    return df.select(*[c for c in df.columns if c in keep], F.inline(F.array(F.struct(*derived))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: lambda bodies share no subexpressions otherwise."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def finite(c) -> Column:
    """False for NULL, NaN and infinities (Spark orders NaN above every number)."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def unit_to_ev(unit) -> Column:
    """Factor to eV, NULL for an unknown unit."""
    unit = col(unit)
    out = F.lit(None).cast("double")
    for name, factor in EV_PER_UNIT.items():
        out = F.when(unit == name, F.lit(factor)).otherwise(out)
    return out


def convert_energy(value, source, target) -> Column:
    """``value`` in ``source`` units expressed in ``target`` units; NULL if a unit is unknown."""
    return col(value) * unit_to_ev(source) / unit_to_ev(target)


def error_decomposition(mlip, dft, reference) -> dict[str, Column]:
    """Signed errors; total = surrogate + reference up to rounding."""
    m, d, r = col(mlip), col(dft), col(reference)
    return {"surrogate_error": m - d, "reference_error": d - r, "total_error": m - r}


def reference_blind(
    surrogate_error, reference_error, surrogate_abs_max: float, reference_abs_min: float,
    decision_changed=None,
) -> Column:
    """The surrogate agrees with a teacher that is itself consequentially wrong (both bounds inclusive)."""
    if surrogate_abs_max < 0 or reference_abs_min < 0:
        raise ValueError("bounds must be non-negative")
    wrong = F.abs(col(reference_error)) >= F.lit(float(reference_abs_min))
    if decision_changed is not None:
        wrong = wrong | col(decision_changed)
    return (F.abs(col(surrogate_error)) <= F.lit(float(surrogate_abs_max))) & wrong


def target_label(predicted, reference, tolerance: float, uncertainty=None) -> Column:
    """1 surely outside tolerance, 0 surely inside, NULL when the uncertainty straddles it."""
    error = F.abs(col(predicted) - col(reference))
    u = F.lit(0.0) if uncertainty is None else F.coalesce(col(uncertainty), F.lit(0.0))
    tol = F.lit(float(tolerance))
    return F.when(error - u > tol, 1).when(error + u <= tol, 0)


def target_labels(surrogate_tolerance, reference_tolerance, decision_tolerance) -> dict[str, Column]:
    """The three training targets of a study row; only the surrogate one ignores uncertainty."""
    return {
        "surrogate": target_label("mlip", "dft", surrogate_tolerance),
        "reference": target_label("dft", "reference", reference_tolerance, "reference_uncertainty"),
        "total": target_label("mlip", "reference", decision_tolerance, "reference_uncertainty"),
    }


def blind_by_label(surrogate_tolerance, reference_tolerance) -> Column:
    """Study variant of blindness: uses the uncertainty-aware reference label."""
    close = F.abs(F.col("mlip") - F.col("dft")) <= F.lit(float(surrogate_tolerance))
    label = target_label("dft", "reference", reference_tolerance, "reference_uncertainty")
    return close & is_true(label == 1)


def all_features(first="mlip_features", second="dft_features") -> Column:
    return F.map_concat(col(first), col(second))


def stage_operations(stage: str, row_id="id", operations="operations", costs="costs") -> Column:
    """Operations of one stage, or a single private operation when none were itemised."""
    private = F.create_map(F.concat(col(row_id).cast("string"), F.lit("/" + stage)), col(costs)[stage])
    return F.coalesce(col(operations)[stage], private)


def spin_contamination(s2, multiplicity) -> Column:
    s = (col(multiplicity) - 1) / F.lit(2.0)
    return F.abs(col(s2) - s * (s + 1))


def orbital_gap(energies, occupations, threshold: float = 1e-6) -> Column:
    """Lowest empty minus highest filled orbital of one channel; NULL if either side is empty."""
    pairs = F.arrays_zip(col(energies).alias("e"), col(occupations).alias("o"))
    filled = F.filter(pairs, lambda p: p["o"] > threshold)
    empty = F.filter(pairs, lambda p: p["o"] <= threshold)
    return F.array_min(F.transform(empty, lambda p: p["e"])) - F.array_max(F.transform(filled, lambda p: p["e"]))


def escalate_once(
    uncertainty, electronic_risk, uq_trigger=0.5, risk_trigger=0.5, cost_penalty=0.05,
    dft_cost=1.0, high_level_cost=20.0,
) -> Column:
    """One-shot heuristic: the dearer action is tried first, each against its cost-scaled margin."""
    for v in (uq_trigger, risk_trigger, cost_penalty):
        if not 0 <= v <= 1:
            raise ValueError("triggers and penalty are probabilities")
    if dft_cost <= 0 or high_level_cost <= 0:
        raise ValueError("costs must be positive")
    dearest = max(dft_cost, high_level_cost)
    return (
        F.when(col(electronic_risk) - risk_trigger >= cost_penalty * (high_level_cost / dearest), "run_high_level")
        .when(col(uncertainty) - uq_trigger >= cost_penalty * (dft_cost / dearest), "run_dft")
        .otherwise("accept_mlip")
    )


def sigmoid(x) -> Column:
    """Logistic function that never exponentiates a large positive number."""
    x = col(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def stationary_point_audit(frequencies, irc_verified, converged=None, threshold: float = 20.0) -> dict[str, Column]:
    """Exactly one clearly imaginary mode, converged, and endpoints confirmed."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    modes = F.size(F.filter(col(frequencies), lambda f: f < -threshold))
    first_order = (modes == 1) & (F.lit(True) if converged is None else col(converged))
    return {
        "imaginary_modes": modes,
        "stationary_order_one": first_order,
        "verified_transition_state": first_order & col(irc_verified),
    }


def vector_summary(values) -> dict[str, Column]:
    """Mean, sample standard deviation and range of an array of at least two numbers."""
    v = col(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    enough = n >= 2
    return {
        "mean": F.when(enough, mean),
        "std": F.when(enough, F.sqrt(squares / (n - 1))),
        "range": F.when(enough, F.array_max(v) - F.array_min(v)),
    }


# ---- content digests --------------------------------------------------------

def content_digest(*columns) -> Column:
    """SHA-256 of the JSON object of the named columns, keys sorted, NULL fields kept."""
    ordered = sorted(columns)
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in ordered]), {"ignoreNullFields": "false"}), 256)


def geometry_hash(symbols="symbols", positions="positions_angstrom", charge="charge", multiplicity="multiplicity") -> Column:
    """Identity of a job's geometry *and* electronic state; the record id plays no part."""
    content = F.struct(
        col(charge).alias("charge"), col(multiplicity).alias("multiplicity"),
        col(positions).alias("positions_angstrom"), col(symbols).alias("symbols"),
    )
    return F.sha2(F.to_json(content), 256)


def hash_unit(*parts) -> Column:
    """Deterministic uniform in [0, 1) from the first 32 bits of an md5: same on any partitioning."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def exact_sum(c) -> Column:
    """Sum of a cost-like double that does not depend on the order of its inputs."""
    return F.sum(col(c).cast("decimal(28,12)")).cast("double")
