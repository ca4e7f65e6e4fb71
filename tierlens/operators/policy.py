"""Sequential accept / escalate / abstain decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_true, settle

# ---- fixed values: reason texts, as they appear in decision tables -----------
REASONS = {
    "screen_all": "screen-all baseline: purchase reference diagnostics",
    "risk_missing": "missing MLIP-stage risk; do not assume reliable",
    "screen_fired": "independent low-fidelity reference prescreen fired",
    "mlip_risk": "MLIP-stage risk exceeds frozen threshold",
    "mlip_ok": "below configured MLIP-stage risk threshold",
    "dft_unusable": "DFT failed: repair the electronic state/convergence first",
    "no_high_level": "no appropriate supported high-level method",
    "reference_risk": "unknown or elevated reference-method risk",
    "reference_ok": "below configured reference-risk threshold",
    "mlip_failed": "MLIP failed",
    "always_mlip": "always-MLIP baseline",
    "dft_failed": "DFT failed",
    "dft_baseline": "baseline accepts DFT",
    "high_level_unavailable": "appropriate high-level method unavailable",
    "high_level_missing": "high-level action has no observed output; not replaced by label",
    "high_level_ok": "observed high-level output",
}
BUDGET_REASONS = {
    "mlip": "MLIP budget exhausted",
    "screen": "prescreen budget exhausted",
    "dft": "DFT budget exhausted; no silent MLIP fallback",
    "diagnostics": "diagnostic budget exhausted",
    "reference_screen": "reference-stage screen budget exhausted",
    "high_level": "high-level budget exhausted",
}
# ---- end of fixed values -----------------------------------------------------

# Purchase steps in the order they can happen; two of them buy the same stage.
STEPS = ("mlip", "screen", "dft", "diagnostics", "reference_screen", "high_level")
STAGE_OF_STEP = {s: "screen" if s == "reference_screen" else s for s in STEPS}


def _verdict(action: str, reason: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(REASONS[reason]).alias("reason"))


def decide_before(risk, screen, risk_threshold, screen_threshold, screen_all) -> Column:
    """Before the teacher calculation: struct(action, reason).  Missing risk never means low risk."""
    risk, screen = col(risk), col(screen)
    return (
        F.when(col(screen_all), _verdict("run_dft", "screen_all"))
        .when(risk.isNull(), _verdict("run_dft", "risk_missing"))
        .when(is_true(screen >= col(screen_threshold)), _verdict("run_dft", "screen_fired"))
        .when(risk >= col(risk_threshold), _verdict("run_dft", "mlip_risk"))
        .otherwise(_verdict("accept_mlip", "mlip_ok"))
    )


def decide_after(risk, dft_succeeded, high_level_supported, risk_threshold) -> Column:
    """After a teacher calculation: struct(action, reason)."""
    risk = col(risk)
    suspicious = risk.isNull() | (risk >= col(risk_threshold))
    return (
        F.when(~col(dft_succeeded), _verdict("abstain", "dft_unusable"))
        .when(suspicious & ~col(high_level_supported), _verdict("abstain", "no_high_level"))
        .when(suspicious, _verdict("run_high_level", "reference_risk"))
        .otherwise(_verdict("accept_dft", "reference_ok"))
    )


def replay_paths(rows: DataFrame, tolerance: float) -> DataFrame:
    """What each row does when money is no object: action, prediction, reason, runs and purchased steps.

    ``rows`` carries the study columns (id, group_id, mlip, dft, reference, reference_uncertainty,
    high_level_value, high_level_supported, cheap_screen), ``mlip_risk`` / ``reference_risk`` and the policy
    of the row (mode, t1, t2, t_screen, screen_all, use_screen, use_diagnostics, use_reference_screen).
    The reference risk is read only on the branch where its features have been bought.
    """
    if tolerance < 0:
        raise ValueError("tolerance must be non-negative")
    mode = F.col("mode")
    only_hl, only_dft = mode == "always_high_level", mode == "always_dft"
    uses_mlip = ~only_hl & ~only_dft
    has_mlip, has_dft = F.col("mlip").isNotNull(), F.col("dft").isNotNull()
    df = rows.withColumns({
        "_uses_mlip": uses_mlip,
        "_reach": ~only_hl & (only_dft | (has_mlip & (mode != "always_mlip"))),
        "_first": decide_before("mlip_risk", F.when(F.col("use_screen"), F.col("cheap_screen")), "t1", "t_screen", "screen_all"),
    })
    df = df.withColumn("_early", F.col("_reach") & ~only_dft & (F.col("_first.action") == "accept_mlip"))
    df = df.withColumn("_dft", F.col("_reach") & ~F.col("_early"))
    df = df.withColumn("_later", F.col("_dft") & has_dft & ~mode.isin("always_dft", "uq_only"))
    df = df.withColumn("_second", F.when(
        F.col("_later"), decide_after("reference_risk", F.lit(True), "high_level_supported", "t2")))
    df = df.withColumn("_hl", F.col("high_level_supported") & (only_hl | is_true(F.col("_second.action") == "run_high_level")))
    observed = F.col("high_level_value").isNotNull()

    def out(action, prediction, reason):
        return F.struct(
            F.lit(action).alias("action"),
            (F.lit(None).cast("double") if prediction is None else F.col(prediction)).alias("prediction"),
            (reason if isinstance(reason, Column) else F.lit(REASONS[reason])).alias("reason"),
        )

    outcome = (
        F.when(F.col("_uses_mlip") & ~has_mlip, out("abstain", None, "mlip_failed"))
        .when(mode == "always_mlip", out("accept_mlip", "mlip", "always_mlip"))
        .when(F.col("_early"), out("accept_mlip", "mlip", F.col("_first.reason")))
        .when(F.col("_dft") & ~has_dft, out("abstain", None, "dft_failed"))
        .when(F.col("_dft") & ~F.col("_later"), out("accept_dft", "dft", "dft_baseline"))
        .when(F.col("_hl") & observed, out("accept_high_level", "high_level_value", "high_level_ok"))
        .when(F.col("_hl"), out("abstain", None, "high_level_missing"))
        .when(only_hl, out("abstain", None, "high_level_unavailable"))
        .when(F.col("_second.action") == "accept_dft", out("accept_dft", "dft", F.col("_second.reason")))
        .otherwise(out("abstain", None, F.col("_second.reason")))
    )
    bought = {
        "mlip": F.col("_uses_mlip"), "screen": F.col("_reach") & F.col("use_screen"), "dft": F.col("_dft"),
        "diagnostics": F.col("_later") & F.col("use_diagnostics"),
        "reference_screen": F.col("_later") & F.col("use_reference_screen"), "high_level": F.col("_hl"),
    }
    df = df.withColumns({
        "_outcome": outcome,
        "purchased": F.array_compact(F.array(*[F.when(bought[s], F.lit(s)) for s in STEPS])),
    })
    helpers = ["_uses_mlip", "_reach", "_first", "_early", "_dft", "_later", "_second", "_hl", "_outcome"]
    return with_score(settle(df.select(
        *[c for c in df.columns if c not in helpers and c != "purchased"], "_outcome.*", "purchased",
        F.col("_dft").alias("ran_dft"), F.col("_hl").alias("ran_high_level"),
    ), keep=rows.columns), tolerance)


def with_score(df: DataFrame, tolerance: float) -> DataFrame:
    """Error of the chosen prediction and whether it is surely within tolerance."""
    error = F.abs(F.col("prediction") - F.col("reference"))
    margin = F.coalesce(F.col("reference_uncertainty"), F.lit(0.0))
    return df.withColumns({
        "absolute_error": error,
        "correct": is_true(error + margin <= F.lit(float(tolerance))),
        "abstained": F.col("prediction").isNull(),
    })
