"""Fit on train / calibration / validation, freeze, then evaluate once on test.

Only fitted parameters, counts and one row per policy reach the driver; rows stay in DataFrames.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import blind_by_label, error_decomposition, is_true, target_labels
from ..operators.features import feature_column, fit_preprocessor
from ..operators.fingerprints import multiset_fingerprint
from ..operators.ledger import apply_ledger, charges, purchases
from ..operators.metrics import (
    blind_rate, classification_report, cluster_bootstrap, raw_score_report, regression_report,
)
from ..operators.models import RiskModel, calibration_audit, fit_risk_models
from ..operators.observables import decision_group_leaks
from ..operators.ordered import pareto_frontier, risk_coverage
from ..operators.replay import default_grid, policy_grid, run_policies, select_policy
from ..operators.splits import grouped_split, pairing_report, partition_of, split_audit
from ..records import AUXILIARY_FEATURES, STAGE_DFT, STAGE_MLIP, check_feature_names
from .lineage import cut_lineage


@dataclass(frozen=True)
class StudyConfig:
    # fixed values: defaults of a study
    seed: int = 42
    surrogate_tolerance: float = 1.0
    reference_tolerance: float = 3.0
    decision_tolerance: float = 3.0
    cost_weight: float = 0.05
    cost_scale: float = 20.0
    l2: float = 1.0
    bootstrap_repetitions: int = 500
    exploratory: bool = False
    synthetic: bool = False
    stage1_features: tuple[str, ...] = ("ensemble_std", "ood_distance", "cheap_screen")
    stage2_features: tuple[str, ...] = (
        "ensemble_std", "ood_distance", "cheap_screen", "homo_lumo_gap_ev", "spin_contamination", "scf_cycles", "fod")
    thresholds: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)

    def __post_init__(self):
        amounts = (self.surrogate_tolerance, self.reference_tolerance, self.decision_tolerance, self.cost_weight)
        if self.seed < 0 or min(amounts) < 0 or self.cost_scale <= 0 or self.l2 <= 0 or self.bootstrap_repetitions < 2:
            raise ValueError("study configuration out of range")
        check_feature_names(self.stage1_features, STAGE_MLIP)
        check_feature_names(self.stage2_features, STAGE_DFT)
        if not self.thresholds or any(not 0 <= t <= 1 for t in self.thresholds):
            raise ValueError("thresholds must be probabilities, at least one")
        if set(self.stage1_features) <= {"cheap_screen"}:
            raise ValueError("a feature besides the screen is needed for the surrogate-only baseline")

    @property
    def labels(self) -> dict[str, Column]:
        return target_labels(self.surrogate_tolerance, self.reference_tolerance, self.decision_tolerance)

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys([*self.stage1_features, *self.stage2_features]))

    @property
    def model_definitions(self) -> dict[str, tuple[list[str], int, str]]:
        plain = [n for n in self.stage1_features if n != "cheap_screen"]
        return {
            "surrogate": (plain, STAGE_MLIP, "surrogate"),
            "total": (list(self.stage1_features), STAGE_MLIP, "total"),
            "reference_mlip_only": (plain, STAGE_MLIP, "reference"),
            "reference_augmented": (list(self.stage2_features), STAGE_DFT, "reference"),
        }

    @property
    def uses_diagnostics(self) -> bool:
        return bool(set(AUXILIARY_FEATURES) & set(self.stage2_features))

    @property
    def uses_reference_screen(self) -> bool:
        return "cheap_screen" in self.stage2_features


# fixed values: exclusion reasons, as they appear in exclusion tables
EXCLUSIONS = {
    "missing": "missing or failed paired calculation/reference",
    "duplicate": "duplicate observable of ",
    "quality": "reference-quality exclusion",
    "unreviewed": "reference needs review or explicit exploratory mode",
    "synthetic": "synthetic row in a table not marked synthetic",
    "ambiguous": "reference uncertainty makes a training target ambiguous",
}


def duplicate_mark(rows: DataFrame) -> Column:
    """The row a row repeats: its ``duplicate_of``, or that of its ``metadata`` (VARIANT, map, struct or JSON text)."""
    marks = [F.col("duplicate_of")] if "duplicate_of" in rows.columns else []
    if "metadata" in rows.columns:
        kind = rows.schema["metadata"].dataType
        if isinstance(kind, T.VariantType):
            marks.append(F.try_variant_get("metadata", "$.duplicate_of", "string"))
        elif isinstance(kind, T.StringType):
            marks.append(F.get_json_object("metadata", "$.duplicate_of"))
        elif isinstance(kind, T.MapType) or "duplicate_of" in kind.fieldNames():
            marks.append(F.col("metadata")["duplicate_of"].cast("string"))
    return F.coalesce(*marks, F.lit(None).cast("string"))


def with_eligibility(rows: DataFrame, config: StudyConfig) -> DataFrame:
    """Adds ``reasons``: all grounds on which a row is kept out of a study (empty = eligible)."""
    quality = F.col("reference_quality")
    duplicate = duplicate_mark(rows)
    grounds = F.array_compact(F.array(
        F.when(F.col("mlip").isNull() | F.col("dft").isNull() | F.col("reference").isNull(), F.lit(EXCLUSIONS["missing"])),
        F.when(F.length(duplicate) > 0, F.concat(F.lit(EXCLUSIONS["duplicate"]), duplicate)),
        F.when(quality.isin("questionable", "multireference_required"), F.lit(EXCLUSIONS["quality"])),
        F.when((quality == "unreviewed") & F.lit(not config.exploratory), F.lit(EXCLUSIONS["unreviewed"])),
        F.when((quality == "synthetic") & F.lit(not config.synthetic), F.lit(EXCLUSIONS["synthetic"])),
    ))
    unclear = F.lit(False)
    for label in config.labels.values():
        unclear = unclear | label.isNull()
    return rows.withColumn("_g", grounds).withColumn("reasons", F.when(
        (F.size("_g") == 0) & unclear, F.array(F.lit(EXCLUSIONS["ambiguous"]))).otherwise(F.col("_g"))).drop("_g")


def split_eligible(rows: DataFrame, config: StudyConfig) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, exclusions with reasons)."""
    judged = with_eligibility(rows, config)
    return (judged.where(F.size("reasons") == 0).drop("reasons"),
            judged.where(F.size("reasons") > 0).select("id", "group_id", "reasons"))


def study_frame(rows: DataFrame, config: StudyConfig) -> DataFrame:
    """Study rows with flat feature and label columns."""
    return rows.select("*", *[feature_column(n) for n in config.features],
                       *[c.alias(f"label_{n}") for n, c in config.labels.items()])


def fingerprint(rows: DataFrame) -> str:
    flat = [c for c in ("id", "group_id", "mlip", "dft", "reference", "reference_quality", "reference_uncertainty",
                        "high_level_value", "high_level_supported", "decision_group") if c in rows.columns]
    maps = [c for c in ("mlip_features", "dft_features", "costs", "operations") if c in rows.columns]
    ordered = rows.select(*flat, *[F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(e))).alias(c) for c in maps])
    return multiset_fingerprint(ordered, [*flat, *maps]).first()["fingerprint"]


def fit_models(train: DataFrame, calibration: DataFrame, config: StudyConfig) -> dict[str, RiskModel]:
    """The four risk models, fitted on train and calibrated on disjoint rows.

    Preprocessing is per feature, so one pass serves every model, and each iteration of the fits is one pass for all.
    """
    prepared = fit_preprocessor(train, config.features, STAGE_DFT)
    wanted = {name: (features, stage, f"label_{target}") for name, (features, stage, target) in config.model_definitions.items()}
    return fit_risk_models(train, calibration, wanted, prepared, config.l2)


def with_risks(df: DataFrame, models: dict[str, RiskModel]) -> DataFrame:
    """One ``risk_<model>`` column per model, plus ``reference_risk`` for the controller."""
    for name, model in models.items():
        df = model.score(df, f"risk_{name}")
    return df.withColumn("reference_risk", F.col("risk_reference_augmented"))


@dataclass(frozen=True)
class Artifact:
    """Everything a frozen study needs for its evaluation; ``split`` and the reports stay distributed."""

    config: StudyConfig
    table_fingerprint: str
    models: dict[str, RiskModel]
    selected: list[dict]
    split: DataFrame = field(compare=False)
    validation: DataFrame = field(compare=False)
    balance: DataFrame = field(compare=False)
    exclusions: DataFrame = field(compare=False)
    fingerprints: dict[str, str] = field(default_factory=dict)
    sha256: str = ""

    def tables(self) -> dict[str, DataFrame]:
        return {"split": self.split, "validation": self.validation, "balance": self.balance, "exclusions": self.exclusions}

    def table_fingerprints(self) -> dict[str, str]:
        """One fingerprint per table as it is now, and one of the ids each model was trained and calibrated on."""
        marks = {name: multiset_fingerprint(_flat(df), df.columns).first()["fingerprint"] for name, df in self.tables().items()}
        for part in ("train", "calibration"):
            ids = self.split.where(F.col("partition") == part).select("id")
            marks[f"{part}_ids"] = multiset_fingerprint(ids, ["id"]).first()["fingerprint"]
        return marks

    def content(self) -> dict:
        return {"config": asdict(self.config), "table": self.table_fingerprint, "selected": self.selected,
                "models": {k: m.to_dict() for k, m in self.models.items()}, "fingerprints": self.fingerprints}

    def digest(self) -> str:
        text = json.dumps(self.content(), sort_keys=True, separators=(",", ":"), allow_nan=False)
        return hashlib.sha256(text.encode()).hexdigest()


def _flat(df: DataFrame) -> DataFrame:
    """Doubles in twelve significant digits, so that a stored table has the fingerprint of the computed one."""
    return df.select(*[
        F.format_string("%.11e", F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def save_artifact(artifact: Artifact, path: str) -> None:
    """Write a frozen study below ``path``: its tables as Parquet, the rest as one line of JSON."""
    spark = artifact.split.sparkSession
    for name, df in artifact.tables().items():
        df.write.mode("error").parquet(f"{path}/{name}")
    text = json.dumps({**artifact.content(), "sha256": artifact.sha256}, sort_keys=True, allow_nan=False)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("error").text(f"{path}/artifact")


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    """Read a frozen study; ``verify_artifact`` decides whether it may be used."""
    value = json.loads(spark.read.text(f"{path}/artifact").first()["value"])
    config = {k: tuple(v) if isinstance(v, list) else v for k, v in value["config"].items()}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("split", "validation", "balance", "exclusions")}
    return Artifact(
        StudyConfig(**config), value["table"], {k: RiskModel.from_dict(m) for k, m in value["models"].items()}, value["selected"],
        fingerprints=value["fingerprints"], sha256=value["sha256"], **tables)


BASELINES = (
    {"name": "always_mlip", "mode": "always_mlip"},
    {"name": "always_dft", "mode": "always_dft"},
    {"name": "always_high_level_observed", "mode": "always_high_level"},
)


def fit_study(rows: DataFrame, config: StudyConfig, pairwise: bool = True) -> Artifact:
    """Split, fit, calibrate and select policies without looking at test labels.

    Decision groups must not cross split groups; conflicting prices stop the ledgers.
    """
    if not decision_group_leaks(rows).isEmpty():
        raise ValueError("a decision group crosses split groups")
    if "cost_unit" in rows.columns and rows.select("cost_unit").distinct().limit(2).count() > 1:
        raise ValueError("the rows of a study must share one cost unit")
    eligible, exclusions = split_eligible(rows, config)
    if eligible.isEmpty():
        raise ValueError("no eligible rows: every row is excluded (see split_eligible)")
    split = cut_lineage(grouped_split(eligible, seed=config.seed))
    # rows carry operations and costs: they are neither joined with the split nor written again
    framed = eligible.withColumn("partition", partition_of(split, seed=config.seed))
    inputs = [*config.features, *[f"label_{n}" for n in config.labels]]
    staged = cut_lineage(study_frame(framed.where(F.col("partition").isin("train", "calibration")), config).select("partition", *inputs))
    train, calibration = (staged.where(F.col("partition") == p) for p in ("train", "calibration"))
    models = fit_models(train, calibration, config)
    validation = with_risks(study_frame(framed.where(F.col("partition") == "validation"), config), models)
    grid = default_grid(config.thresholds, "cheap_screen" in config.stage1_features)
    scores = cut_lineage(policy_grid(
        validation, grid, config.decision_tolerance, config.cost_weight, config.cost_scale,
        config.uses_diagnostics, config.uses_reference_screen, pairwise))
    best = {r["name"]: grid[r["policy_id"]] for r in select_policy(scores).collect()}  # one row per variant
    balance = calibration_audit(rows.sparkSession, models)
    artifact = Artifact(
        config, fingerprint(rows), models, [*BASELINES, *best.values()], split, scores, cut_lineage(balance), cut_lineage(exclusions))
    artifact = replace(artifact, fingerprints=artifact.table_fingerprints())
    return replace(artifact, sha256=artifact.digest())


def _long(df: DataFrame, section: str, name: Column | str | None = None) -> DataFrame:
    """Any report as (section, name, metric, value) rows."""
    label = F.lit("all") if name is None else (F.col(name) if isinstance(name, str) else name)
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "decimal", "boolean")
               and not (isinstance(name, str) and f.name == name)]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    return df.select(F.lit(section).alias("section"), label.cast("string").alias("name"), F.explode(pairs).alias("_m")).select(
        "section", "name", "_m.*")


@dataclass(frozen=True)
class Evaluation:
    report: DataFrame
    decisions: DataFrame
    audit: DataFrame
    risk_coverage: DataFrame
    pareto: DataFrame


def verify_artifact(rows: DataFrame, artifact: Artifact) -> None:
    """Refuse a changed artifact (its split, scores and model rows included), another table, or leaked test rows."""
    if artifact.sha256 != artifact.digest():
        raise ValueError("frozen artifact hash mismatch")
    found = artifact.table_fingerprints()
    changed = sorted(k for k in found if found[k] != artifact.fingerprints.get(k))
    if changed:
        raise ValueError(f"frozen artifact does not match its tables: {changed}")
    eligible, _ = split_eligible(rows, artifact.config)
    development = artifact.split.where(F.col("partition").isin("train", "calibration", "validation")).select("id")
    checks = pairing_report(fingerprint(rows), artifact.table_fingerprint, eligible, artifact.split, development)
    broken = [r["rule"] for r in checks.unionByName(split_audit(artifact.split, eligible)).collect() if r["violations"]]
    if broken:
        raise ValueError(f"frozen study does not fit this table: {broken}")


def scored_test_rows(rows: DataFrame, artifact: Artifact) -> DataFrame:
    """Eligible test rows with every model's risk, the labels and the blind flag."""
    config = artifact.config
    eligible, _ = split_eligible(rows, config)
    test_ids = artifact.split.where(F.col("partition") == "test").select("id")
    test = with_risks(study_frame(eligible, config).join(test_ids, "id", "left_semi"), artifact.models)
    return test.withColumn("blind", blind_by_label(config.surrogate_tolerance, config.reference_tolerance))


def evaluate_study(rows: DataFrame, artifact: Artifact, order_by: str = "ord", verify: bool = True) -> Evaluation:
    """All test-set reports of a frozen study."""
    config = artifact.config
    if verify:
        verify_artifact(rows, artifact)
    test = cut_lineage(scored_test_rows(rows, artifact))

    parts = [_long(blind_rate(test, "blind"), "reference_blind")]
    for name, (_, _, target) in config.model_definitions.items():
        parts.append(_long(classification_report(test, f"label_{target}", f"risk_{name}"), "detection", F.lit(name)))
    parts.append(_long(raw_score_report(test, "ensemble_std", {t: f"label_{t}" for t in config.labels}), "raw_ensemble", "target"))
    for label, a, b in (("mlip_vs_dft", "mlip", "dft"), ("dft_vs_reference", "dft", "reference"), ("mlip_vs_reference", "mlip", "reference")):
        parts.append(_long(regression_report(test, a, b), "regression", F.lit(label)))

    replayed = lambda chosen: run_policies(test, chosen, config.decision_tolerance, config.uses_diagnostics, config.uses_reference_screen)
    # what the policies cost and decide needs no row per row and policy, and without a budget no ledger changes a decision
    summary = cut_lineage(policy_grid(
        test, artifact.selected, config.decision_tolerance, config.cost_weight, config.cost_scale, config.uses_diagnostics,
        config.uses_reference_screen).drop("policy_id", "definition_digest"))
    parts.append(_long(summary, "policies", "name"))
    frontier = pareto_frontier(summary.withColumn("_risk", 1 - F.col("accuracy_all_cases")), "mean_cost", "_risk")
    share = lambda p: F.max(F.when(F.col("name") == p, F.col("correct").cast("double")))
    compared = [d for d in artifact.selected if d["name"] in ("sequential_reference", "always_dft")]
    paired = replayed(compared).groupBy("id", "group_id").agg((share("sequential_reference") - share("always_dft")).alias("delta"))
    if test.select("group_id").distinct().limit(2).count() > 1:
        parts.append(_long(cluster_bootstrap(paired, "delta", "group_id", config.bootstrap_repetitions, seed=config.seed), "paired_difference"))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    paths, keys = replayed(artifact.selected), ["policy_id"]
    decisions = apply_ledger(paths, charges(purchases(paths, keys, order_by), keys), keys, config.decision_tolerance, order_by)
    curves = [risk_coverage(test, "label_reference", f"risk_{m}").withColumn("model", F.lit(m))
              for m in ("reference_mlip_only", "reference_augmented")]
    return Evaluation(
        report, decisions.select(F.col("name").alias("policy"), F.col("id").alias("row_id"), "group_id", "action", "prediction",
                                 "cost", "ran_dft", "ran_high_level", "reason", "absolute_error", "correct", "abstained"),
        test_audit(test, artifact.models), curves[0].unionByName(curves[1]), frontier.select("name", "mean_cost", "accuracy_all_cases"))


def test_audit(test: DataFrame, models) -> DataFrame:
    """Per test row: errors, the blind flag and every model's risk."""
    errors = error_decomposition("mlip", "dft", "reference")
    return test.select("id", "group_id", "mlip", "dft", "reference", is_true(F.col("blind")).alias("reference_blind"),
                       *[c.alias(n) for n, c in errors.items()], *[f"risk_{m}" for m in models])


test_audit.__test__ = False  # keeps pytest from collecting it


def run_study(rows: DataFrame, config: StudyConfig, order_by: str = "ord") -> tuple[Artifact, Evaluation]:
    artifact = fit_study(rows, config)
    return artifact, evaluate_study(rows, artifact, order_by)
