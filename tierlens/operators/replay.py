"""Policy summaries, threshold grids and selection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_sum
from .lattice import lattice_charges, lattice_rows, lattice_summary, lattices
from .pairs import decision_pairs
from .policy import replay_paths


def definition_table(definitions: Sequence[dict]) -> list[dict]:
    """Policy definitions with every default filled in and a digest that breaks selection ties."""
    out = []
    for i, d in enumerate(definitions):
        full = {
            "name": d["name"], "mode": d.get("mode", "sequential"), "stage1": d.get("stage1", "total"),
            "t1": float(d.get("t1", 0.2)), "t2": float(d.get("t2", 0.2)), "t_screen": float(d.get("t_screen", 0.5)),
            "screen_all": bool(d.get("screen_all", False)), "use_screen": bool(d.get("use_screen", False)),
        }
        if not all(0 <= full[t] <= 1 for t in ("t1", "t2", "t_screen")):
            raise ValueError("thresholds are probabilities")
        text = json.dumps(full, sort_keys=True, separators=(",", ":"))
        out.append({"policy_id": i, **full, "definition_digest": hashlib.sha256(text.encode()).hexdigest()})
    return out


def with_policies(rows: DataFrame, definitions: Sequence[dict]) -> DataFrame:
    """Every row under every definition: a narrow explode of a literal array, no join."""
    entries = F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in d.items()]) for d in definition_table(definitions)
    ])
    return rows.select("*", F.explode(entries).alias("_d")).select(*rows.columns, "_d.*")


def default_grid(thresholds: Sequence[float], screen_in_stage1: bool) -> list[dict]:
    """All candidate definitions: spread only, spread + reference, sequential, screen everything."""
    grid = []
    for t1 in thresholds:
        grid.append({"name": "uq_only", "mode": "uq_only", "stage1": "surrogate", "t1": t1, "t2": 1.0})
        for t2 in thresholds:
            grid.append({"name": "uq_reference", "stage1": "surrogate", "t1": t1, "t2": t2})
            grid.append({"name": "sequential_reference", "t1": t1, "t2": t2, "use_screen": screen_in_stage1})
    for t2 in thresholds:
        grid.append({"name": "screen_all_reference", "t1": 0.0, "t2": t2, "screen_all": True})
    return grid


def replay_summary(
    results: DataFrame, keys: Sequence[str], cost_weight: float = 0.05, cost_scale: float = 20.0,
    pairwise: bool = True,
) -> DataFrame:
    """Coverage, accuracy, error, ``cost`` and objective per policy; abstentions count as not correct."""
    if cost_weight < 0 or cost_scale <= 0:
        raise ValueError("cost_weight must be non-negative and cost_scale positive")
    keys = list(keys)
    share = lambda c: F.avg(F.col(c).cast("double"))
    base = results.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((~F.col("abstained")).cast("double")).alias("coverage"),
        share("correct").alias("accuracy_all_cases"),
        F.sum((~F.col("abstained")).cast("long")).alias("_accepted"),
        F.sum(F.col("correct").cast("long")).alias("_correct"),
        F.avg("absolute_error").alias("mae_accepted"),
        share("ran_dft").alias("dft_call_fraction"),
        share("ran_high_level").alias("high_level_call_fraction"),
        exact_sum("cost").alias("total_cost"),
    )
    mean_cost = F.col("total_cost") / F.col("n")
    out = base.select(
        *keys, "n", "coverage", "accuracy_all_cases",
        F.try_divide(F.col("_correct").cast("double"), F.col("_accepted").cast("double")).alias("accuracy_accepted"),
        "mae_accepted", "total_cost", mean_cost.alias("mean_cost"), "dft_call_fraction", "high_level_call_fraction",
        (1 - F.col("accuracy_all_cases") + F.lit(float(cost_weight)) * mean_cost / F.lit(float(cost_scale))).alias("objective"),
    )
    if not pairwise:
        return out
    grouped = decision_pairs(results, [*keys, "decision_group"]).groupBy(*keys).agg(
        F.sum("resolved").alias("pairs_resolved"), F.sum("unresolved").alias("pairs_unresolved"),
        F.sum("correct").alias("_pairs_correct"))
    zero = F.lit(0).cast("long")
    return out.join(grouped, keys, "left").withColumns({
        "pairwise_ordering_accuracy": F.try_divide(F.col("_pairs_correct").cast("double"), F.col("pairs_resolved").cast("double")),
        "pairs_resolved": F.coalesce("pairs_resolved", zero),
        "pairs_unresolved": F.coalesce("pairs_unresolved", zero),
    }).drop("_pairs_correct")


def choose_risk(df: DataFrame) -> DataFrame:
    """``mlip_risk`` = the first-stage risk the row's definition asks for."""
    return df.withColumn("mlip_risk", F.when(F.col("stage1") == "surrogate", F.col("risk_surrogate")).otherwise(F.col("risk_total")))


def run_policies(
    scored: DataFrame, definitions: Sequence[dict], tolerance: float, use_diagnostics: bool = True,
    use_reference_screen: bool = True,
) -> DataFrame:
    """Replay rows (with risk_surrogate, risk_total, reference_risk) under every definition.

    Every row turns into one per definition, so rows are first spread evenly by id; per-row aggregations over
    the definitions then need no further shuffle.
    """
    spread = scored.repartition("id") if len(definitions) > 1 else scored
    staged = choose_risk(with_policies(spread, definitions)).withColumns({
        "use_diagnostics": F.lit(use_diagnostics), "use_reference_screen": F.lit(use_reference_screen)})
    return replay_paths(staged, tolerance)


def policy_grid(
    scored: DataFrame, definitions: Sequence[dict], tolerance: float,
    cost_weight: float = 0.05, cost_scale: float = 20.0, use_diagnostics: bool = True,
    use_reference_screen: bool = True, pairwise: bool = True, tie_tolerance: float = 0.0,
) -> DataFrame:
    """One summary row per definition, each with a ledger of its own.

    No row is repeated per definition: see :mod:`lattice`.
    """
    if cost_weight < 0 or cost_scale <= 0:
        raise ValueError("cost_weight must be non-negative and cost_scale positive")
    if tolerance < 0:
        raise ValueError("tolerance must be non-negative")
    known = definition_table(definitions)
    out = lattice_summary(scored, known, tolerance, cost_weight, cost_scale, use_diagnostics, use_reference_screen, pairwise, tie_tolerance)
    at = lambda field: F.element_at(F.array(*[F.lit(d[field]) for d in known]), F.col("policy_id") + 1)
    return out.select("policy_id", *[at(c).alias(c) for c in ("name", "definition_digest")], *[c for c in out.columns if c != "policy_id"])


def policy_charges(
    scored: DataFrame, definitions: Sequence[dict], order_by: str, use_diagnostics: bool = True, use_reference_screen: bool = True,
) -> DataFrame:
    """(policy_id, row_no, cost) of ledgers without a budget, one per definition; rows that pay for nothing are left out."""
    grid = lattices(definition_table(definitions))
    rows = lattice_rows(scored, grid, ["id", order_by, "operations", "costs"])
    return lattice_charges(rows, grid, order_by, use_diagnostics, use_reference_screen)


def select_policy(summaries: DataFrame) -> DataFrame:
    """Best definition of every variant: lowest objective, then mean cost, then digest."""
    best = F.min(F.struct("objective", "mean_cost", "definition_digest", "policy_id")).alias("_b")
    return summaries.groupBy("name").agg(best).select("name", "_b.policy_id", "_b.objective", "_b.mean_cost", "_b.definition_digest")
