"""Decision, ledger, replay and study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.operators import ledger, models, policy, replay
from tierlens.plans import study as P
from tierlens.plans.lineage import cut_lineage

from . import views as S
from .assembly import SQL_SPLIT, split_of
from .basics import CONFIG, SQL_LABELLED, labelled
from .ranking import rounded
from .registry import query

POLICIES = [
    {"name": "always_mlip", "mode": "always_mlip"},
    {"name": "always_dft", "mode": "always_dft"},
    {"name": "always_high_level", "mode": "always_high_level"},
    {"name": "uq_only", "mode": "uq_only", "stage1": "surrogate", "t1": 0.5, "t2": 1.0},
    {"name": "sequential", "t1": 0.5, "t2": 0.5, "use_screen": True},
]
GRID = replay.default_grid(P.StudyConfig().thresholds, True)


def sql_definitions(definitions) -> str:
    rows = ", ".join(
        "({policy_id}, '{name}', '{mode}', '{stage1}', {t1}::DOUBLE, {t2}::DOUBLE, {t_screen}::DOUBLE, {screen_all}, {use_screen}, '{definition_digest}')".format(**d)
        for d in replay.definition_table(definitions))
    return f"defs(policy_id, name, mode, stage1, t1, t2, t_screen, screen_all, use_screen, definition_digest) AS (VALUES {rows})"


def sql_paths(definitions) -> str:
    """Replay without a budget as plain CASE logic over study x definitions."""
    r = {k: v.replace("'", "''") for k, v in policy.REASONS.items()}
    return f"""{S.SQL_STUDY}, {sql_definitions(definitions)},
staged AS (SELECT study.*, defs.*, CASE WHEN stage1 = 'surrogate' THEN risk_surrogate ELSE risk_total END AS mlip_risk,
  mode = 'always_high_level' AS only_hl, mode = 'always_dft' AS only_dft FROM study, defs),
s1 AS (SELECT *, NOT only_hl AND (only_dft OR (mlip IS NOT NULL AND mode <> 'always_mlip')) AS reach,
  CASE WHEN screen_all THEN '{r['screen_all']}' WHEN mlip_risk IS NULL THEN '{r['risk_missing']}'
       WHEN use_screen AND cheap_screen >= t_screen THEN '{r['screen_fired']}' WHEN mlip_risk >= t1 THEN '{r['mlip_risk']}' ELSE '{r['mlip_ok']}' END AS why1 FROM staged),
s2 AS (SELECT *, reach AND NOT only_dft AND why1 = '{r['mlip_ok']}' AS early FROM s1),
s3 AS (SELECT *, reach AND NOT early AS ran_dft, reach AND NOT early AND dft IS NOT NULL AND mode NOT IN ('always_dft', 'uq_only') AS later,
  reference_risk IS NULL OR reference_risk >= t2 AS risky FROM s2),
s4 AS (SELECT *, high_level_supported AND (only_hl OR (later AND risky)) AS ran_high_level FROM s3),
paths AS (SELECT *,
  CASE WHEN NOT only_hl AND NOT only_dft AND mlip IS NULL THEN 'abstain' WHEN mode = 'always_mlip' OR early THEN 'accept_mlip'
       WHEN ran_dft AND dft IS NULL THEN 'abstain' WHEN ran_dft AND NOT later THEN 'accept_dft'
       WHEN ran_high_level THEN CASE WHEN high_level_value IS NULL THEN 'abstain' ELSE 'accept_high_level' END
       WHEN only_hl THEN 'abstain' WHEN NOT risky THEN 'accept_dft' ELSE 'abstain' END AS action,
  CASE WHEN NOT only_hl AND NOT only_dft AND mlip IS NULL THEN '{r['mlip_failed']}' WHEN mode = 'always_mlip' THEN '{r['always_mlip']}' WHEN early THEN why1
       WHEN ran_dft AND dft IS NULL THEN '{r['dft_failed']}' WHEN ran_dft AND NOT later THEN '{r['dft_baseline']}'
       WHEN ran_high_level THEN CASE WHEN high_level_value IS NULL THEN '{r['high_level_missing']}' ELSE '{r['high_level_ok']}' END
       WHEN only_hl THEN '{r['high_level_unavailable']}' WHEN NOT risky THEN '{r['reference_ok']}' ELSE '{r['no_high_level']}' END AS reason,
  concat_ws(',', CASE WHEN NOT only_hl AND NOT only_dft THEN 'mlip' END, CASE WHEN reach AND use_screen THEN 'screen' END, CASE WHEN ran_dft THEN 'dft' END,
    CASE WHEN later THEN 'diagnostics' END, CASE WHEN later THEN 'reference_screen' END, CASE WHEN ran_high_level THEN 'high_level' END) AS purchased FROM s4),
scored_paths AS (SELECT *, CASE action WHEN 'accept_mlip' THEN mlip WHEN 'accept_dft' THEN dft WHEN 'accept_high_level' THEN high_level_value END AS prediction FROM paths),
replayed AS (SELECT *, ABS(prediction - reference) AS absolute_error, prediction IS NULL AS abstained,
  COALESCE(ABS(prediction - reference) + COALESCE(reference_uncertainty, 0) <= {S.DECISION_TOL}, FALSE) AS correct FROM scored_paths)"""


SQL_LEDGER = f"""{S.SQL_OPERATIONS},
bought AS (SELECT r.policy_id, r.id, r.ord, o.op, o.cost, list_position(['mlip', 'screen', 'dft', 'diagnostics', 'reference_screen', 'high_level'], o.step) AS step_no
  FROM replayed r JOIN step_ops o ON o.id = r.id AND list_contains(string_split(r.purchased, ','), o.step)),
payers AS (SELECT policy_id, op, MIN(cost) AS cost, arg_min(id, ord * 8 + step_no) AS id FROM bought GROUP BY 1, 2)"""
SQL_SUMMARY = """
base AS (SELECT policy_id, name, definition_digest, COUNT(*) AS n, AVG((NOT abstained)::INT) AS coverage, AVG(correct::INT) AS accuracy_all_cases,
  SUM(correct::INT) / NULLIF(SUM((NOT abstained)::INT), 0) AS accuracy_accepted, AVG(absolute_error) AS mae_accepted,
  AVG(ran_dft::INT) AS dft_call_fraction, AVG(ran_high_level::INT) AS high_level_call_fraction FROM replayed GROUP BY 1, 2, 3),
money AS (SELECT policy_id, SUM(cost)::DOUBLE AS total_cost FROM payers GROUP BY 1),
summary AS (SELECT base.*, COALESCE(total_cost, 0) AS total_cost, COALESCE(total_cost, 0) / n AS mean_cost,
  1 - accuracy_all_cases + 0.05 * (COALESCE(total_cost, 0) / n) / 20 AS objective FROM base LEFT JOIN money USING (policy_id))"""
SQL_ROUNDED = ("ROUND(coverage, 6) AS coverage, ROUND(accuracy_all_cases, 6) AS accuracy_all_cases, ROUND(accuracy_accepted, 6) AS accuracy_accepted, "
               "ROUND(mae_accepted, 4) AS mae_accepted, ROUND(total_cost, 4) AS total_cost, ROUND(mean_cost, 6) AS mean_cost, "
               "ROUND(dft_call_fraction, 6) AS dft_call_fraction, ROUND(high_level_call_fraction, 6) AS high_level_call_fraction, ROUND(objective, 6) AS objective")


def summary_columns(df):
    digits = {"mae_accepted": 4, "total_cost": 4}
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits.get(c, 6)) for c in doubles})


def rows_with_operations(t):
    return S.with_operations(t, S.study(t))


@query("decide_before", f"""WITH {sql_paths(POLICIES)} SELECT id, why1 AS reason, CASE WHEN why1 = '{policy.REASONS['mlip_ok']}' THEN 'accept_mlip' ELSE 'run_dft' END AS action
FROM s1 WHERE name = 'sequential'""")
def _(t):
    d = policy.decide_before("risk_total", "cheap_screen", F.lit(0.5), F.lit(0.5), F.lit(False))
    return S.study(t).select("id", d.alias("d")).select("id", "d.reason", "d.action")


@query("decide_after", f"""WITH {S.SQL_STUDY} SELECT id, CASE WHEN dft IS NULL THEN 'abstain' WHEN reference_risk IS NULL OR reference_risk >= 0.5 THEN
  CASE WHEN high_level_supported THEN 'run_high_level' ELSE 'abstain' END ELSE 'accept_dft' END AS action FROM study""")
def _(t):
    d = policy.decide_after("reference_risk", F.col("dft").isNotNull(), "high_level_supported", F.lit(0.5))
    return S.study(t).select("id", d["action"].alias("action"))


@query("replay_policy", f"""WITH {sql_paths(POLICIES)} SELECT name, id, action, reason, prediction, purchased, ran_dft, ran_high_level, absolute_error, correct, abstained FROM replayed""")
def _(t):
    return replay.run_policies(S.study(t), POLICIES, S.DECISION_TOL).select(
        "name", "id", "action", "reason", "prediction", F.concat_ws(",", "purchased").alias("purchased"), "ran_dft", "ran_high_level",
        "absolute_error", "correct", "abstained")


@query("ledger_dedupe", f"""WITH {sql_paths(POLICIES)}, {SQL_LEDGER} SELECT policy_id, id AS row_id, SUM(cost)::DOUBLE AS cost FROM payers GROUP BY 1, 2""")
def _(t):
    return replay.policy_charges(rows_with_operations(t), POLICIES, "ord").withColumnRenamed("row_no", "row_id")


# The walk itself: a fold over each ledger's purchases in order, whose state is the last element folded in.
SQL_WALK = f"""{SQL_LEDGER},
numbered AS (SELECT op, (ROW_NUMBER() OVER (ORDER BY op))::INT AS no FROM (SELECT DISTINCT op FROM step_ops)),
stepped AS (
  SELECT r.policy_id, r.priority, r.id, r.ord, list_position(['mlip', 'screen', 'dft', 'diagnostics', 'reference_screen', 'high_level'], o.step)::INT AS step_no,
    LIST(n.no ORDER BY n.no) AS ops, LIST(o.cost::DECIMAL(18,2) ORDER BY n.no) AS costs
  FROM replayed r JOIN step_ops o ON o.id = r.id AND list_contains(string_split(r.purchased, ','), o.step) JOIN numbered n ON n.op = o.op GROUP BY ALL),
walked AS (
  SELECT policy_id, priority, list_reduce(list_prepend(
      {{'id': -1::BIGINT, 'step_no': 0, 'ops': []::INT[], 'costs': []::DECIMAL(18,2)[], 'spent': 0::DECIMAL(18,2), 'owned': []::INT[], 'ended': -1::BIGINT, 'said': []::STRUCT(id BIGINT, step_no INT, price DECIMAL(18,2), paid BOOLEAN)[]}},
      LIST({{'id': id::BIGINT, 'step_no': step_no, 'ops': ops, 'costs': costs, 'spent': NULL::DECIMAL(18,2), 'owned': NULL::INT[], 'ended': NULL::BIGINT, 'said': NULL::STRUCT(id BIGINT, step_no INT, price DECIMAL(18,2), paid BOOLEAN)[]}} ORDER BY ord, step_no)),
    lambda s, x: CASE
      WHEN x.id = s.ended THEN s
      WHEN s.spent + list_sum(list_transform(list_zip(x.ops, x.costs), lambda z: CASE WHEN list_contains(s.owned, z[1]) THEN 0 ELSE z[2] END)) <= 500 THEN
        {{'id': x.id, 'step_no': x.step_no, 'ops': x.ops, 'costs': x.costs,
          'spent': (s.spent + list_sum(list_transform(list_zip(x.ops, x.costs), lambda z: CASE WHEN list_contains(s.owned, z[1]) THEN 0 ELSE z[2] END)))::DECIMAL(18,2),
          'owned': list_distinct(list_concat(s.owned, x.ops)), 'ended': s.ended,
          'said': list_append(s.said, {{'id': x.id, 'step_no': x.step_no,
            'price': list_sum(list_transform(list_zip(x.ops, x.costs), lambda z: CASE WHEN list_contains(s.owned, z[1]) THEN 0 ELSE z[2] END))::DECIMAL(18,2), 'paid': true}})}}
      ELSE {{'id': x.id, 'step_no': x.step_no, 'ops': x.ops, 'costs': x.costs, 'spent': s.spent, 'owned': s.owned, 'ended': x.id,
          'said': list_append(s.said, {{'id': x.id, 'step_no': x.step_no, 'price': 0::DECIMAL(18,2), 'paid': false}})}} END).said AS said
  FROM stepped GROUP BY 1, 2),
said AS (SELECT policy_id, priority, UNNEST(said) AS v FROM walked),
told AS (SELECT policy_id, priority, v.id AS id, SUM(v.price) AS cost, MIN(CASE WHEN NOT v.paid THEN v.step_no END) AS refused FROM said GROUP BY 1, 2, 3)"""
SQL_BUDGET_REASONS = " ".join(f"WHEN {n} THEN '{policy.BUDGET_REASONS[step]}'" for n, step in enumerate(policy.STEPS, start=1))


@query("ledger_budgeted", f"""WITH {sql_paths(POLICIES)}, {SQL_WALK}
SELECT r.policy_id, r.priority, CASE WHEN refused IS NULL THEN r.action ELSE 'abstain' END AS action,
  CASE WHEN refused IS NULL THEN r.reason ELSE CASE refused {SQL_BUDGET_REASONS} END END AS reason, COUNT(*) AS n, ROUND(SUM(COALESCE(cost, 0)::DOUBLE), 6) AS cost
FROM replayed r LEFT JOIN told t ON t.policy_id = r.policy_id AND t.priority = r.priority AND t.id = r.id GROUP BY 1, 2, 3, 4""")
def _(t):
    paths = replay.run_policies(rows_with_operations(t), POLICIES, S.DECISION_TOL)
    keys = ["policy_id", "priority"]
    bought = cut_lineage(ledger.purchases(paths, keys, "ord"))
    charged = ledger.charge_with_budget(bought, keys, 500.0)
    return ledger.apply_ledger(paths, charged, keys, S.DECISION_TOL).groupBy(*keys, "action", "reason").agg(
        F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


SQL_PAIRS = """pairs AS (SELECT a.policy_id, a.prediction - b.prediction AS c, a.reference - b.reference AS r, COALESCE(a.reference_uncertainty, 0) + COALESCE(b.reference_uncertainty, 0) AS u
  FROM replayed a JOIN replayed b ON a.policy_id = b.policy_id AND a.decision_group = b.decision_group AND a.ord < b.ord),
pc AS (SELECT policy_id, COUNT(*) FILTER (c IS NOT NULL AND ABS(r) > u) AS pairs_resolved, COUNT(*) FILTER (c IS NULL OR ABS(r) <= u) AS pairs_unresolved,
  COUNT(*) FILTER ((c > 0 AND r > u) OR (c < 0 AND r < -u)) AS ok FROM pairs GROUP BY 1)"""


@query("replay_summary", f"""WITH {sql_paths(POLICIES)}, {SQL_LEDGER}, {SQL_SUMMARY}, {SQL_PAIRS}
SELECT name, n, {SQL_ROUNDED}, pairs_resolved, pairs_unresolved, ROUND(ok / NULLIF(pairs_resolved, 0), 6) AS pairwise_ordering_accuracy FROM summary JOIN pc USING (policy_id)""")
def _(t):
    # a ledger of its own and all pairs for every policy, without a row per row and policy
    return summary_columns(replay.policy_grid(rows_with_operations(t), POLICIES, S.DECISION_TOL)).drop("policy_id", "definition_digest")


@query("policy_grid", f"""WITH {sql_paths(GRID)}, {SQL_LEDGER}, {SQL_SUMMARY}, {SQL_PAIRS}
SELECT policy_id, name, definition_digest, n, {SQL_ROUNDED}, pairs_resolved, pairs_unresolved, ROUND(ok / NULLIF(pairs_resolved, 0), 6) AS pairwise_ordering_accuracy
FROM summary JOIN pc USING (policy_id)""")
def _(t):
    return summary_columns(replay.policy_grid(rows_with_operations(t), GRID, S.DECISION_TOL))


@query("select_policy", f"""WITH {sql_paths(GRID)}, {SQL_LEDGER}, {SQL_SUMMARY}, ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY ROUND(objective, 9), ROUND(mean_cost, 9), definition_digest) AS place FROM summary)
SELECT name, policy_id, ROUND(objective, 6) AS objective, ROUND(mean_cost, 6) AS mean_cost, definition_digest FROM ranked WHERE place = 1""")
def _(t):
    grid = replay.policy_grid(rows_with_operations(t), GRID, S.DECISION_TOL, pairwise=False)
    return rounded(replay.select_policy(rounded(grid, 9)), 6)


# ---- models and studies ------------------------------------------------------

def model_rows(t):
    return cut_lineage(labelled(t).select(
        "id", "group_id", "label_surrogate", "label_reference", "label_total", "n_lines", *CONFIG.features))


@query("score_logistic", f"""WITH {S.SQL_STUDY}, x AS (SELECT id, 0.25::DOUBLE + -1.5::DOUBLE * cheap_screen + 0.125::DOUBLE * scf_cycles AS z FROM study)
SELECT id, z, ROUND(CASE WHEN z >= 0 THEN 1 / (1 + EXP(-z)) ELSE EXP(z) / (1 + EXP(z)) END, 12) AS p FROM x""")
def _(t):
    model = models.LogisticModel(1.0, 0.25, (-1.5, 0.125), n=1, positives=0)
    inputs = [F.col("cheap_screen"), F.col("scf_cycles")]
    return S.study(t).select("id", model.logit(inputs).alias("z"), F.round(model.probability(inputs), 12).alias("p"))


SQL_PARTED = f"""{SQL_LABELLED}, {SQL_SPLIT}, parted AS (
  SELECT labelled.*, partition FROM labelled JOIN split ON split.id = labelled.id
  WHERE label_surrogate IS NOT NULL AND label_reference IS NOT NULL AND label_total IS NOT NULL)"""


def parted(t):
    rows = model_rows(t).where("label_surrogate is not null and label_reference is not null and label_total is not null")
    return cut_lineage(rows.join(split_of(t).select("id", "partition"), "id"))


# A fit is right exactly if the gradient of its penalised loss vanishes: one residual per coefficient, all 0.
def sql_residuals(models_terms: dict[str, list[str]], where: dict[str, str]) -> str:
    parts = [f"SELECT '{m}' AS model, term, n, 0.0::DOUBLE AS residual FROM (SELECT COUNT(*) AS n FROM parted WHERE {where[m]}), (SELECT UNNEST({terms!r}) AS term)"
             for m, terms in models_terms.items()]
    return SQL_PARTED + " " + " UNION ALL ".join(parts)


def residuals(model: str, rows, fitted, inputs, label):
    found = models.score_residuals(rows, fitted, inputs, label)
    # -0.0 and 0.0 are the same residual
    return found.select(F.lit(model).alias("model"), "term", "n", (F.round("residual", 4) + 0.0).alias("residual"))


@query("fit_logistic", sql_residuals({"plain": ["intercept", "ood_distance", "scf_cycles"]}, {"plain": "TRUE"}))
def _(t):
    rows, names = parted(t), ["ood_distance", "scf_cycles"]
    fitted = models.fit_logistic(rows, names, "label_surrogate")
    return residuals("plain", rows, fitted, {n: F.col(n) for n in names}, "label_surrogate")


@query("calibrate", sql_residuals({"calibrator": ["intercept", "logit"]}, {"calibrator": "partition = 'calibration'"}))
def _(t):
    rows = parted(t)
    train, held = rows.where("partition = 'train'"), rows.where("partition = 'calibration'")
    base = models.fit_risk_model(train, ["ood_distance", "cheap_screen"], 0, "label_surrogate")
    tuned = models.calibrate(base, held, "label_surrogate", train)
    return residuals("calibrator", held, tuned.calibrator, {"logit": tuned.logit()}, "label_surrogate")


def _risk_terms(features) -> list[str]:
    return ["intercept", *[f"z_{n}" for n in features], *[f"missing_{n}" for n in features]]


SQL_RISK = sql_residuals(
    {m: _risk_terms(fs) for m, (fs, _, _) in CONFIG.model_definitions.items()} | {f"{m}, calibrated": ["intercept", "logit"] for m in CONFIG.model_definitions},
    {m: "partition = 'train'" for m in CONFIG.model_definitions} | {f"{m}, calibrated": "partition = 'calibration'" for m in CONFIG.model_definitions})


@query("fit_risk_models", SQL_RISK)
def _(t):
    rows = parted(t)
    train, held = rows.where("partition = 'train'"), rows.where("partition = 'calibration'")
    out = None
    for name, model in P.fit_models(train, held, CONFIG).items():
        features, _, target = CONFIG.model_definitions[name]
        columns = dict(zip(_risk_terms(features)[1:], model.preprocessor.columns(F.col)))
        for part in (residuals(name, train, model.model, columns, f"label_{target}"),
                     residuals(f"{name}, calibrated", held, model.calibrator, {"logit": model.logit()}, f"label_{target}")):
            out = part if out is None else out.unionByName(part)
    return out


SQL_AUDIT = " UNION ALL ".join(
    f"SELECT '{name}' AS model, COUNT(*) FILTER (partition = 'train') AS train_n, SUM((partition = 'train')::INT * label_{target})::BIGINT AS train_positive, "
    f"COUNT(*) FILTER (partition = 'calibration') AS calibration_n, SUM((partition = 'calibration')::INT * label_{target})::BIGINT AS calibration_positive, "
    f"COUNT(DISTINCT CASE WHEN partition = 'train' THEN label_{target} END) = 1 AS training_single_class, "
    f"COUNT(DISTINCT CASE WHEN partition = 'calibration' THEN label_{target} END) = 1 AS calibration_single_class, "
    "TRUE AS optimizer_converged, TRUE AS calibration_optimizer_converged FROM parted"
    for name, (_, _, target) in CONFIG.model_definitions.items())


@query("calibration_audit", f"{SQL_PARTED} {SQL_AUDIT}")
def _(t):
    rows = parted(t)
    fitted = P.fit_models(rows.where("partition = 'train'"), rows.where("partition = 'calibration'"), CONFIG)
    return models.calibration_audit(t.spark, fitted)


@query("risk_model_scores")
def _(t):
    rows = parted(t)
    fitted = models.fit_risk_model(rows.where("partition = 'train'"), CONFIG.stage2_features, 1, "label_reference")
    return rounded(fitted.score(rows, "risk").select("id", "risk"), 6)


def study_rows(t):
    """All orders as study rows with feature, cost and operation maps."""
    rows = S.with_operations(t, S.study(t))
    pick = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return rows.select(
        F.col("id").cast("string").alias("id"), F.col("group_id").cast("string").alias("group_id"), "ord", "mlip", "dft", "reference",
        "reference_quality", "reference_uncertainty", "high_level_value", "high_level_supported",
        F.col("decision_group").cast("string").alias("decision_group"), "operations", "costs", "cheap_screen",
        pick("ensemble_std", "ood_distance", "cheap_screen").alias("mlip_features"),
        pick("homo_lumo_gap_ev", "spin_contamination", "scf_cycles", "fod").alias("dft_features")).drop("cheap_screen")


STUDY = P.StudyConfig(
    surrogate_tolerance=S.SURROGATE_TOL, reference_tolerance=S.REFERENCE_TOL, decision_tolerance=S.DECISION_TOL)


@query("fit_study")
def _(t):
    artifact = P.fit_study(cut_lineage(study_rows(t)), STUDY)
    return summary_columns(artifact.validation.select("name", "policy_id", "n", "accuracy_all_cases", "total_cost", "objective"))


SQL_TEST_ROWS = f"""{SQL_LABELLED}, eligible AS (
  SELECT * FROM labelled WHERE reference_quality = 'reviewed' AND label_surrogate IS NOT NULL AND label_reference IS NOT NULL AND label_total IS NOT NULL),
{SQL_SPLIT.replace("SELECT DISTINCT o_custkey AS g FROM orders", "SELECT DISTINCT group_id AS g FROM eligible").replace(
    "SELECT o_orderkey AS id, o_custkey AS group_id, p AS partition FROM orders JOIN r ON g = o_custkey", "SELECT id, group_id, p AS partition FROM eligible JOIN r ON g = group_id")},
test AS (SELECT *, ABS(mlip - dft) <= {S.SURROGATE_TOL} AND label_reference = 1 AS blind FROM eligible WHERE id IN (SELECT id FROM split WHERE partition = 'test'))"""
SQL_REGRESSION = " UNION ALL ".join(
    f"SELECT 'regression' AS section, '{a}_vs_{b}' AS name, UNNEST(['n', 'mae', 'rmse', 'bias', 'max_abs']) AS metric, "
    f"UNNEST([COUNT(*)::DOUBLE, AVG(ABS({a} - {b})), SQRT(AVG(({a} - {b}) * ({a} - {b}))), AVG({a} - {b}), MAX(ABS({a} - {b}))]) AS value FROM test"
    for a, b in (("mlip", "dft"), ("dft", "reference"), ("mlip", "reference")))


# what a report says without any fitted model, in SQL: a wrong split or eligibility shows here
@query("evaluate_study_exact", f"""{SQL_TEST_ROWS}, cost AS (SELECT 0.03::DOUBLE * COUNT(DISTINCT l_partkey) AS c FROM lineitem WHERE l_orderkey IN (SELECT id FROM test)),
always AS (SELECT COUNT(*)::DOUBLE AS n, AVG((ABS(mlip - reference) + COALESCE(reference_uncertainty, 0) <= {S.DECISION_TOL})::INT) AS ok, AVG(ABS(mlip - reference)) AS mae FROM test)
SELECT section, name, metric, ROUND(value, 4) AS value FROM (
  SELECT 'reference_blind' AS section, 'all' AS name, UNNEST(['n', 'blind_count', 'blind_fraction', 'uncertainty_missing']) AS metric,
    UNNEST([COUNT(*)::DOUBLE, SUM(blind::INT)::DOUBLE, AVG(blind::INT), COUNT(*) FILTER (reference_uncertainty IS NULL)::DOUBLE]) AS value FROM test
  UNION ALL {SQL_REGRESSION}
  UNION ALL SELECT 'policies', 'always_mlip', UNNEST(['n', 'coverage', 'accuracy_all_cases', 'accuracy_accepted', 'mae_accepted', 'total_cost', 'mean_cost', 'dft_call_fraction', 'high_level_call_fraction', 'objective']),
    UNNEST([n, 1, ok, ok, mae, c, c / n, 0, 0, 1 - ok + 0.05 * (c / n) / 20]) FROM always, cost)""")
def _(t):
    rows = cut_lineage(study_rows(t))
    report = P.evaluate_study(rows, P.fit_study(rows, STUDY, pairwise=False)).report  # pair counts of validation are not reported
    exact = F.col("section").isin("reference_blind", "regression") | ((F.col("name") == "always_mlip") & ~F.col("metric").startswith("pair"))
    return rounded(report.where(exact), 4)


@query("test_audit_errors", f"""{SQL_TEST_ROWS} SELECT id::VARCHAR AS id, group_id::VARCHAR AS group_id, blind AS reference_blind, ROUND(mlip - dft, 6) AS surrogate_error,
  ROUND(dft - reference, 6) AS reference_error, ROUND(mlip - reference, 6) AS total_error FROM test""")
def _(t):
    rows = cut_lineage(study_rows(t))
    artifact = P.fit_study(rows, STUDY, pairwise=False)  # pair counts are not part of an audit
    audit = P.test_audit(P.scored_test_rows(rows, artifact), artifact.models)
    return rounded(audit.select("id", "group_id", "reference_blind", "surrogate_error", "reference_error", "total_error"), 6)


@query("evaluate_study")
def _(t):
    rows = cut_lineage(study_rows(t))
    artifact = P.fit_study(rows, STUDY, pairwise=False)  # pair counts of validation are not reported
    return rounded(P.evaluate_study(rows, artifact).report, 6)


@query("test_audit")
def _(t):
    rows = cut_lineage(study_rows(t))
    artifact = P.fit_study(rows, STUDY, pairwise=False)  # pair counts are not part of an audit
    return rounded(P.test_audit(P.scored_test_rows(rows, artifact), artifact.models), 6)
