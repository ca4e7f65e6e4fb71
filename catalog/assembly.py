"""Observable assembly, enrichment, split and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.operators import enrich, observables as O, splits
from tierlens.operators.fingerprints import multiset_fingerprint
from tierlens.operators.validation import duplicate_keys
from tierlens.plans.study import StudyConfig, with_eligibility
from tierlens.sources.datasets import dataset_violations, merge_calculations

from . import views as S
from .ranking import rounded
from .registry import query

METHODS = ["A", "N", "R", "H"]
SQL_INPUT = f"WITH {S.SQL_CALCULATIONS}, {S.SQL_TERMS}, {S.SQL_STRUCTURES}"
SQL_PARTS = """, methods AS (SELECT UNNEST(['A', 'N', 'R', 'H']) AS method_id),
parts AS (
  SELECT t.observable_id, m.method_id, t.pos, t.coefficient * c.energy AS v, c.cost, c.scf_cycles, c.homo_lumo_gap_ev, c.spin_contamination, c.status,
    CASE WHEN c.structure_id IS NULL THEN 'missing calculation ' || t.structure_id || '/' || m.method_id
         WHEN c.status <> 'succeeded' THEN 'unusable calculation ' || t.structure_id || ': ' || c.status
         WHEN s.stale THEN 'geometry/state mismatch for ' || t.structure_id END AS problem,
    t.structure_id
  FROM terms t CROSS JOIN methods m JOIN structures s ON s.id = t.structure_id
  LEFT JOIN calculations c ON c.structure_id = t.structure_id AND c.method_id = m.method_id),
assembled AS (
  SELECT observable_id, method_id, arg_min(problem, pos) FILTER (problem IS NOT NULL) AS failure_reason,
    SUM(v ORDER BY pos) AS raw_value, SUM(cost::DECIMAL(28,12))::DOUBLE AS raw_cost, COUNT(*) AS k,
    CASE WHEN COUNT(*) FILTER (status = 'succeeded') = COUNT(*) THEN MAX(scf_cycles) END AS scf_cycles,
    CASE WHEN COUNT(*) FILTER (status = 'succeeded') = COUNT(*) THEN MIN(homo_lumo_gap_ev) END AS gap,
    CASE WHEN COUNT(*) FILTER (status = 'succeeded') = COUNT(*) THEN MAX(spin_contamination) END AS spin
  FROM parts GROUP BY 1, 2),
results AS (SELECT *, CASE WHEN failure_reason IS NULL THEN raw_value END AS value, CASE WHEN failure_reason IS NULL THEN raw_cost END AS cost FROM assembled)"""


@query("union_calculations", f"""WITH {S.SQL_CALCULATIONS} SELECT method_id, status, COUNT(*) AS n, 0 AS duplicates FROM calculations GROUP BY 1, 2""")
def _(t):
    c = S.calculations(t)
    merged = merge_calculations(*[c.where(F.col("method_id") == m) for m in METHODS])
    keyed = merged.join(duplicate_keys(merged, "structure_id", "method_id"), ["structure_id", "method_id"], "left")
    return keyed.groupBy("method_id", "status").agg(F.count("*").alias("n"), F.count("copies").alias("duplicates"))


@query("assemble_observable", f"""{SQL_INPUT}{SQL_PARTS}
SELECT observable_id, method_id, ROUND(value, 6) AS value, cost, failure_reason FROM results""")
def assembled(t):
    out = O.assemble_observables(S.terms(t), S.calculations(t), S.structures(t), METHODS)
    return out.select("observable_id", "method_id", F.round("value", 6).alias("value"), "cost", "failure_reason")


@query("ensemble_std", f"""{SQL_INPUT}{SQL_PARTS}
SELECT observable_id, COUNT(value) AS members, ROUND(STDDEV_SAMP(value), 6) AS ensemble_std FROM results WHERE method_id <> 'R' AND value IS NOT NULL GROUP BY 1""")
def _(t):
    out = O.assemble_observables(S.terms(t), S.calculations(t), S.structures(t), ["A", "N", "H"])
    return rounded(O.ensemble_std(out), 6)


@query("check_balance", f"""WITH {S.SQL_TERMS}
SELECT observable_id, p_type AS element, SUM(coefficient) AS net, ABS(SUM(coefficient)) <= 1e-8 AS balanced
FROM terms JOIN part ON p_partkey::VARCHAR = structure_id GROUP BY 1, 2""")
def _(t):
    elements = t.part.select(F.col("p_partkey").cast("string").alias("structure_id"), F.col("p_type").alias("element"), F.lit(1).alias("count"))
    return O.balance_report(S.terms(t), elements)


@query("assemble_study", f"""{SQL_INPUT}{SQL_PARTS}, {S.SQL_STUDY},
wide AS (SELECT observable_id,
  MAX(value) FILTER (method_id = 'A') AS mlip, MAX(value) FILTER (method_id = 'R') AS dft, MAX(value) FILTER (method_id = 'H') AS high_level_value,
  CASE WHEN COUNT(value) FILTER (method_id IN ('A', 'N')) = 2 THEN STDDEV_SAMP(value) FILTER (method_id IN ('A', 'N')) END AS ensemble_std,
  MAX(scf_cycles) FILTER (method_id = 'R') AS scf_cycles, MAX(gap) FILTER (method_id = 'R') AS homo_lumo_gap_ev, MAX(spin) FILTER (method_id = 'R') AS spin_contamination,
  COALESCE(SUM(raw_cost) FILTER (method_id IN ('A', 'N')), 0) AS cost_mlip, COALESCE(MAX(raw_cost) FILTER (method_id = 'R'), 0) AS cost_dft, MAX(raw_cost) FILTER (method_id = 'H') AS cost_high_level,
  COUNT(failure_reason) AS failures FROM results GROUP BY 1)
SELECT observable_id AS id, 'customer-' || group_id AS group_id, ROUND(wide.mlip, 6) AS mlip, ROUND(wide.dft, 6) AS dft, ROUND(wide.high_level_value, 6) AS high_level_value,
  ROUND(reference, 6) AS reference, ROUND(reference_uncertainty, 6) AS reference_uncertainty, reference_quality, ROUND(wide.ensemble_std, 6) AS ensemble_std, wide.scf_cycles, wide.homo_lumo_gap_ev, wide.spin_contamination,
  ROUND(cost_mlip, 6) AS cost_mlip, ROUND(cost_dft, 6) AS cost_dft, ROUND(cost_high_level, 6) AS cost_high_level, failures
FROM wide JOIN study ON study.id = observable_id::BIGINT""")
def _(t):
    rows = O.assemble_study(S.observables(t), S.terms(t), S.calculations(t), S.structures(t), ["A", "N"], "R", "H")
    cost = lambda s: F.round(F.col("costs")[s], 6).alias(f"cost_{s}")
    return rows.select(
        "id", "group_id", *[F.round(c, 6).alias(c) for c in ("mlip", "dft", "high_level_value")], F.round("reference", 6).alias("reference"),
        F.round("reference_uncertainty", 6).alias("reference_uncertainty"), "reference_quality",
        F.round(F.col("mlip_features")["ensemble_std"], 6).alias("ensemble_std"),
        *[F.col("dft_features")[n].alias(n) for n in ("scf_cycles", "homo_lumo_gap_ev", "spin_contamination")],
        cost("mlip"), cost("dft"), cost("high_level"), F.size("failures").alias("failures"))


@query("assembled_study_eligibility", f"""{SQL_INPUT}{SQL_PARTS}, {S.SQL_STUDY},
wide AS (SELECT observable_id, MAX(value) FILTER (method_id = 'A') AS mlip, MAX(value) FILTER (method_id = 'R') AS dft FROM results GROUP BY 1),
keys AS (SELECT observable_id, string_agg(CASE WHEN coefficient > 0 THEN '+' ELSE '-' END || p_type, ',' ORDER BY CASE WHEN coefficient > 0 THEN '+' ELSE '-' END || p_type) AS key
  FROM terms JOIN part ON p_partkey::VARCHAR = structure_id GROUP BY 1),
marked AS (SELECT observable_id, MIN(observable_id::BIGINT) OVER (PARTITION BY key) AS first FROM keys),
judged AS (SELECT observable_id AS id, wide.mlip, wide.dft, reference, reference_quality AS q, reference_uncertainty AS u, CASE WHEN first <> observable_id::BIGINT THEN first END AS dup
  FROM wide JOIN study ON study.id = observable_id::BIGINT JOIN marked USING (observable_id))
SELECT id, dup::VARCHAR AS duplicate_of, concat_ws('; ',
  CASE WHEN mlip IS NULL OR dft IS NULL OR reference IS NULL THEN 'missing or failed paired calculation/reference' END,
  CASE WHEN dup IS NOT NULL THEN 'duplicate observable of ' || dup END, CASE WHEN q = 'questionable' THEN 'reference-quality exclusion' END,
  CASE WHEN q = 'unreviewed' THEN 'reference needs review or explicit exploratory mode' END) AS reasons FROM judged""")
def _(t):
    # two observables are copies if their terms agree in part type and sign
    types = t.part.select(F.col("p_partkey").cast("string").alias("structure_id"), "p_type")
    kinds = S.terms(t).join(types, "structure_id").groupBy("observable_id").agg(F.collect_list(
        F.concat(F.when(F.col("coefficient") > 0, "+").otherwise("-"), "p_type")).alias("kinds"))
    seen = S.observables(t).join(kinds, F.col("id") == F.col("observable_id")).drop("observable_id").withColumn("ord", F.col("id").cast("long"))
    marked = enrich.mark_duplicates(seen, order_by="ord", terms="kinds").drop("kinds")
    rows = O.assemble_study(marked, S.terms(t), S.calculations(t), S.structures(t), ["A", "N"], "R", "H", require_teacher=True)
    # wide tolerances leave no target ambiguous
    config = StudyConfig(surrogate_tolerance=0.0, reference_tolerance=0.0, decision_tolerance=0.0)
    judged = with_eligibility(rows.withColumn("reference_uncertainty", F.lit(None).cast("double")), config)
    return judged.select("id", "duplicate_of", F.array_join("reasons", "; ").alias("reasons"))


@query("method_guards", f"""WITH {S.SQL_CALCULATIONS}
SELECT 'duplicate_calculation' AS rule, COUNT(*) AS violations FROM calculations WHERE method_id = 'H' UNION ALL
SELECT 'fidelity_mismatch', COUNT(*) FROM calculations WHERE method_id = 'N' UNION ALL SELECT 'mixed_cost_units', 1""")
def _(t):
    c = S.calculations(t)
    again = c.where("method_id = 'H'").withColumn("cost_unit", F.lit("hours"))  # a second record in another unit
    return O.method_guards(c.unionByName(again), ["A"], "N", "H")


@query("teacher_match", f"""WITH {S.SQL_CALCULATIONS}
SELECT COUNT(*) FILTER (method_id <> 'R') AS mlip_records, COUNT(*) FILTER (method_id = 'R') AS dft_records, 2 AS teachers,
  COUNT(*) FILTER (status = 'failed' AND method_id <> 'N') AS unnamed, COUNT(*) FILTER (method_id = 'R' AND status = 'failed') AS unverified, FALSE AS matched
FROM calculations WHERE method_id <> 'H'""")
def _(t):
    failed = F.col("status") == "failed"
    c = S.calculations(t).withColumns({
        "teacher_id": F.when(F.col("method_id") == "N", "another").when(~failed, F.col("teacher_id")),
        "teacher_verified": F.col("teacher_verified") & ~failed})
    return O.teacher_match(c, ["A", "N"], "R")


@query("teacher_match_clean", f"""WITH {S.SQL_CALCULATIONS}
SELECT COUNT(*) FILTER (method_id <> 'R') AS mlip_records, COUNT(*) FILTER (method_id = 'R') AS dft_records, 1 AS teachers, 0 AS unnamed, 0 AS unverified, TRUE AS matched
FROM calculations WHERE method_id <> 'H'""")
def _(t):
    return O.teacher_match(S.calculations(t), ["A", "N"], "R")


@query("shared_cost_conflicts", """SELECT 'part/' || l_partkey AS operation, MIN(l_tax) AS lowest, MAX(l_tax) AS highest, COUNT(*) AS uses
FROM (SELECT l_orderkey, l_partkey, MAX(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING MIN(l_tax) <> MAX(l_tax)""")
def _(t):
    ops = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_tax").alias("c")).groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("part/"), F.col("l_partkey")), "c"))).alias("ops"))
    return O.shared_cost_conflicts(ops.select(F.create_map(F.lit("dft"), F.col("ops")).alias("operations")))


@query("decision_group_leaks", """SELECT o_custkey AS decision_group, MIN(o_orderpriority) AS first_group, MAX(o_orderpriority) AS last_group
FROM orders GROUP BY 1 HAVING MIN(o_orderpriority) <> MAX(o_orderpriority)""")
def _(t):
    return O.decision_group_leaks(t.orders.select(F.col("o_custkey").alias("decision_group"), F.col("o_orderpriority").alias("group_id")))


@query("dataset_rules", f"""WITH {S.SQL_TERMS}, o AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM good))
SELECT 'no_structures' AS rule, 0 AS violations UNION ALL SELECT 'no_observables', 0
UNION ALL SELECT 'duplicate_structure', COUNT(*) FROM part WHERE p_brand = 'Brand#7'
UNION ALL SELECT 'duplicate_observable', COUNT(*) FROM o WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'decision_group_crosses_groups', COUNT(*) FROM (SELECT o_custkey FROM o GROUP BY 1 HAVING COUNT(DISTINCT o_orderpriority) > 1)""")
def _(t):
    parts = S.structures(t)
    seen = S.observables(t).withColumn("group_id", F.col("reference.source"))  # split by priority instead of customer
    return dataset_violations(parts.unionByName(parts.where("geometry_hash = 'stale'")), seen.unionByName(seen.where("group_id = '1-URGENT'")))


# ---- enrichment --------------------------------------------------------------

SQL_ATTACH = f"""WITH {S.SQL_STUDY} SELECT id, CASE WHEN status = 'F' THEN n_lines * 0.5 ELSE fod END AS fod, spin_contamination,
  CASE WHEN status = 'F' THEN 0.3::DOUBLE + 8.0 ELSE 0.3::DOUBLE END AS cost_diagnostics,
  CASE WHEN status = 'F' THEN 2 ELSE 0 END AS operations FROM study"""


def attachable(t, *more):
    rows = S.study(t)
    one = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])
    return rows.select(
        "id", "status", "n_lines", one(ensemble_std=F.col("ensemble_std")).alias("mlip_features"),
        one(fod=F.when(F.col("status") != "F", F.col("fod")), spin_contamination=F.col("spin_contamination")).alias("dft_features"),
        one(mlip=F.lit(0.03), dft=F.lit(1.0), high_level=F.lit(20.0), screen=F.lit(0.05), diagnostics=F.lit(0.3)).alias("costs"),
        F.expr("cast(map() as map<string,map<string,double>>)").alias("operations"), *more)


def attachments(t):
    rows = attachable(t).where("status = 'F'")
    return rows.select(
        F.col("id").alias("row_id"), F.lit("diagnostics").alias("stage"), F.create_map(F.lit("fod"), F.col("n_lines") * 0.5).alias("features"),
        F.create_map(F.concat(F.lit("fod-"), F.col("id")), F.lit(8.0)).alias("operations"),
        F.struct(F.lit("separate run").alias("method"), F.sha2(F.col("id").cast("string"), 256).alias("source_sha256")).alias("provenance"))


@query("attach_features", SQL_ATTACH)
def _(t):
    out = enrich.attach_features(attachable(t), attachments(t))
    return out.select("id", F.col("dft_features")["fod"].alias("fod"), F.col("dft_features")["spin_contamination"].alias("spin_contamination"),
                      F.col("costs")["diagnostics"].alias("cost_diagnostics"),
                      F.coalesce(F.size(F.col("operations")["diagnostics"]), F.lit(0)).alias("operations"))


@query("attachment_violations", f"""WITH {S.SQL_STUDY} SELECT id + CASE WHEN priority = '5-LOW' THEN 1000000000 ELSE 0 END AS row_id, UNNEST([x FOR x IN [
  CASE WHEN priority = '5-LOW' THEN 'unknown_row' END, CASE WHEN priority <> '5-LOW' AND fod IS NOT NULL AND status <> 'F' THEN 'overwrites_feature' END,
  CASE WHEN n_lines IS NULL THEN 'operation_cost' END] IF x IS NOT NULL]) AS rule FROM study""")
def _(t):
    rows = attachable(t)
    bad = attachable(t, "priority").select(
        (F.col("id") + F.when(F.col("priority") == "5-LOW", 1_000_000_000).otherwise(0)).alias("row_id"), F.lit("diagnostics").alias("stage"),
        F.create_map(F.lit("fod"), F.lit(1.0)).alias("features"),
        F.create_map(F.lit("run"), F.when(F.col("n_lines").isNull(), -1.0).otherwise(8.0)).alias("operations"),
        F.struct(F.lit("m").alias("method"), F.sha2(F.lit("x"), 256).alias("source_sha256")).alias("provenance"))
    return enrich.attachment_violations(rows, bad)


def reviews(t):
    r = S.study(t).where("status = 'F'")
    return r.select(F.col("id").cast("string").alias("observable_id"), F.lit("kim").alias("reviewer"),
                    F.when(F.col("priority") == "1-URGENT", "questionable").otherwise("reviewed").alias("quality"), F.col("priority").alias("note"),
                    F.when(F.col("n_lines") > 3, 5.0).alias("uncertainty"))


@query("apply_reviews", f"""WITH {S.SQL_TERMS}, {S.SQL_STUDY} SELECT id::VARCHAR AS id, reference AS value,
  CASE WHEN status = 'F' THEN CASE WHEN priority = '1-URGENT' THEN 'questionable' ELSE 'reviewed' END ELSE reference_quality END AS quality,
  CASE WHEN status = 'F' AND n_lines > 3 THEN 5.0 ELSE reference_uncertainty END AS uncertainty,
  CASE WHEN status = 'F' THEN 'kim: ' || priority WHEN reference_quality = 'reviewed' THEN 'checked' ELSE '' END AS review_note
FROM study WHERE id IN (SELECT l_orderkey FROM good)""")
def _(t):
    obs = S.observables(t)
    wanted = reviews(t).join(obs.select(F.col("id").alias("observable_id")), "observable_id", "left_semi")
    return enrich.apply_reviews(obs, wanted).select("id", "reference.value", "reference.quality", "reference.uncertainty", "reference.review_note")


@query("review_violations", f"""WITH {S.SQL_TERMS}, {S.SQL_STUDY} SELECT id::VARCHAR AS observable_id, 'unknown_observable' AS rule
FROM study WHERE status = 'F' AND id NOT IN (SELECT l_orderkey FROM good)""")
def _(t):
    return enrich.review_violations(S.observables(t), reviews(t))


@query("mark_duplicates", """WITH k AS (SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS key FROM lineitem GROUP BY 1),
f AS (SELECT key, MIN(id) AS first FROM k GROUP BY key)
SELECT id, CASE WHEN first <> id THEN first END AS duplicate_of FROM k JOIN f ON k.key = f.key""")
def _(t):
    obs = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.struct("l_returnflag", "l_linestatus")).alias("terms"))
    return enrich.mark_duplicates(obs).select("id", "duplicate_of")


# ---- splits ------------------------------------------------------------------

SQL_SPLIT = """g AS (SELECT DISTINCT o_custkey AS g FROM orders), r AS (
  SELECT g, ROW_NUMBER() OVER (ORDER BY sha256('42|' || g)) AS rk FROM g),
f(p, ord, share) AS (VALUES ('train', 1, 0.5::DOUBLE), ('calibration', 2, 0.2::DOUBLE), ('validation', 3, 0.15::DOUBLE), ('test', 4, 0.15::DOUBLE)),
d AS (SELECT p, ord, share * ((SELECT COUNT(*) FROM g) - 4) AS want FROM f),
b AS (SELECT *, FLOOR(want) + 1 AS base, ROW_NUMBER() OVER (ORDER BY want - FLOOR(want) DESC, ord) AS turn FROM d),
c AS (SELECT p, ord, base + CASE WHEN turn <= (SELECT COUNT(*) FROM g) - (SELECT SUM(base) FROM b) THEN 1 ELSE 0 END AS size FROM b),
u AS (SELECT p, SUM(size) OVER (ORDER BY ord) AS upto, SUM(size) OVER (ORDER BY ord) - size AS above FROM c),
split AS (SELECT o_orderkey AS id, o_custkey AS group_id, p AS partition FROM orders JOIN r ON g = o_custkey JOIN u ON rk > above AND rk <= upto)"""


def split_of(t):
    return splits.grouped_split(t.orders, "o_orderkey", "o_custkey", seed=42)


@query("grouped_split", f"WITH {SQL_SPLIT} SELECT id, group_id, partition FROM split")
def _(t):
    return split_of(t)


@query("split_audit", f"""WITH {SQL_SPLIT}, bad AS (
  SELECT id, split.group_id, CASE WHEN o_orderstatus = 'P' THEN 'train' ELSE partition END AS p FROM split JOIN orders ON o_orderkey = id WHERE partition <> 'validation')
SELECT 'group_leakage' AS rule, COUNT(*) AS violations FROM (SELECT group_id FROM bad GROUP BY 1 HAVING COUNT(DISTINCT p) > 1)
UNION ALL SELECT 'empty_partition', 1 UNION ALL SELECT 'key_mismatch', COUNT(*) FROM split WHERE partition = 'validation'""")
def _(t):
    status = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    bad = split_of(t).where("partition <> 'validation'").join(status, "id").withColumn(
        "partition", F.when(F.col("o_orderstatus") == "P", "train").otherwise(F.col("partition")))
    return splits.split_audit(bad.drop("o_orderstatus"), t.orders, "o_orderkey", "o_custkey")


@query("split_audit_clean", """SELECT 'group_leakage' AS rule, 0 AS violations UNION ALL SELECT 'empty_partition', 0 UNION ALL SELECT 'key_mismatch', 0""")
def _(t):
    return splits.split_audit(split_of(t), t.orders, "o_orderkey", "o_custkey")


@query("ids_in_partition", f"WITH {SQL_SPLIT} SELECT id FROM split WHERE partition = 'test'")
def _(t):
    return splits.ids_in_partition(split_of(t), "test")


@query("disjoint_ids", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("id"))
    return splits.disjoint_ids(side("A"), side("R"))


@query("same_keys", """SELECT o_orderkey AS id, 'left' AS only_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def _(t):
    return splits.key_differences(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.select(F.col("l_orderkey").alias("id")))


@query("connected_groups", """WITH RECURSIVE l AS (SELECT DISTINCT doc_id, md5(line) AS e FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents) WHERE LENGTH(line) > 0),
s AS (SELECT l.doc_id AS v, m.u FROM l JOIN (SELECT e, MIN(doc_id) AS u FROM l GROUP BY e) m ON l.e = m.e),
edges AS (SELECT DISTINCT u AS a, v AS b FROM s WHERE u <> v UNION SELECT DISTINCT v, u FROM s WHERE u <> v),
reach(r, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.c FROM reach JOIN edges e ON e.a = reach.r WHERE e.b > reach.c)
SELECT d.doc_id AS row_id, MIN(c) AS component FROM documents d JOIN reach ON r = d.doc_id GROUP BY 1""")
def _(t):
    return splits.connected_groups(S.document_entities(t))


@query("verify_pairing", f"WITH {SQL_SPLIT} SELECT 'table_fingerprint' AS rule, 1 AS violations UNION ALL SELECT 'split_keys', COUNT(*) FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'test_in_development', COUNT(*) FROM split WHERE partition = 'test' AND id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"))
    mark = multiset_fingerprint(rows, ["id", "group_id"]).first()["fingerprint"]
    leaky = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    other = multiset_fingerprint(rows.where("id % 7 <> 0"), ["id", "group_id"]).first()["fingerprint"]
    fewer = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"))
    return splits.pairing_report(mark, other, fewer, split_of(t), leaky)
