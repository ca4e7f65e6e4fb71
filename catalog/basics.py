"""Column-level queries: units, errors, labels, eligibility, decisions, digests, validation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierlens.functions import columns as C
from tierlens.operators import fingerprints, metrics, observables as O, validation as V
from tierlens.plans.study import StudyConfig, with_eligibility
from tierlens.records import STAGE_MLIP, feature_verdict
from tierlens.sources import datasets

from . import views as S
from .registry import query

CONFIG = StudyConfig(
    surrogate_tolerance=S.SURROGATE_TOL, reference_tolerance=S.REFERENCE_TOL, decision_tolerance=S.DECISION_TOL)
ERRORS = "mlip - dft AS surrogate_error, dft - reference AS reference_error, mlip - reference AS total_error"
COMPLETE = "mlip IS NOT NULL AND dft IS NOT NULL AND reference IS NOT NULL"


def complete(t):
    return S.study(t).where("mlip is not null and dft is not null and reference is not null")


def sql_label(pred: str, ref: str, tol: float, u: str = "0") -> str:
    return (f"CASE WHEN ABS({pred} - {ref}) - COALESCE({u}, 0) > {tol} THEN 1 "
            f"WHEN ABS({pred} - {ref}) + COALESCE({u}, 0) <= {tol} THEN 0 END")


SQL_LABELS = (
    f"{sql_label('mlip', 'dft', S.SURROGATE_TOL)} AS label_surrogate, "
    f"{sql_label('dft', 'reference', S.REFERENCE_TOL, 'reference_uncertainty')} AS label_reference, "
    f"{sql_label('mlip', 'reference', S.DECISION_TOL, 'reference_uncertainty')} AS label_total")


def labelled(t):
    return complete(t).select("*", *[c.alias(f"label_{n}") for n, c in CONFIG.labels.items()])


SQL_LABELLED = f"WITH {S.SQL_STUDY}, labelled AS (SELECT *, {SQL_LABELS} FROM study WHERE {COMPLETE}) "


@query("convert_energy", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_extendedprice * f1 / (4.184::DOUBLE / 96.48533212331002::DOUBLE) AS kcal
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 27.211386245988::DOUBLE
        WHEN 'R' THEN 1.0::DOUBLE / 96.48533212331002::DOUBLE END AS f1 FROM lineitem)""")
def _(t):
    unit = F.when(F.col("l_returnflag") == "A", "eV").when(F.col("l_returnflag") == "N", "hartree").otherwise("kJ/mol")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                             C.convert_energy("l_extendedprice", unit, F.lit("kcal/mol")).alias("kcal"))


@query("error_decomposition", f"WITH {S.SQL_STUDY} SELECT id, {ERRORS} FROM study WHERE {COMPLETE}")
def _(t):
    return complete(t).select("id", *[c.alias(n) for n, c in C.error_decomposition("mlip", "dft", "reference").items()])


@query("reference_blind", f"""WITH {S.SQL_STUDY} SELECT id,
  ABS(mlip - dft) <= 3000 AND ABS(dft - reference) >= 100000 AS blind,
  ABS(mlip - dft) <= 3000 AND (ABS(dft - reference) >= 100000 OR status = 'F') AS blind_or_decision,
  ABS(mlip - dft) <= 3000 AND COALESCE(ABS(dft - reference) - COALESCE(reference_uncertainty, 0) > 100000, FALSE) AS blind_by_label
FROM study WHERE {COMPLETE}""")
def _(t):
    d = C.error_decomposition("mlip", "dft", "reference")
    s, r = d["surrogate_error"], d["reference_error"]
    return complete(t).select(
        "id", C.reference_blind(s, r, 3000, 100000).alias("blind"),
        C.reference_blind(s, r, 3000, 100000, F.col("status") == "F").alias("blind_or_decision"),
        C.blind_by_label(3000, 100000).alias("blind_by_label"))


@query("blind_rate", f"""WITH {S.SQL_STUDY}, flagged AS (
  SELECT *, ABS(mlip - dft) <= 3000 AND ABS(dft - reference) >= 100000 AS blind FROM study WHERE {COMPLETE})
SELECT priority, COUNT(*) AS n, SUM(blind::INT)::BIGINT AS blind_count, ROUND(AVG(blind::INT::DOUBLE), 9) AS blind_fraction,
  SUM((reference_uncertainty IS NULL)::INT)::BIGINT AS uncertainty_missing
FROM flagged GROUP BY priority""")
def blind_rate(t):
    d = C.error_decomposition("mlip", "dft", "reference")
    flagged = complete(t).withColumn("blind", C.reference_blind(d["surrogate_error"], d["reference_error"], 3000, 100000))
    return metrics.blind_rate(flagged, "blind", keys=["priority"]).withColumn("blind_fraction", F.round("blind_fraction", 9))


@query("target_labels", f"{SQL_LABELLED} SELECT id, label_surrogate, label_reference, label_total FROM labelled")
def _(t):
    return labelled(t).select("id", "label_surrogate", "label_reference", "label_total")


@query("eligible_rows", f"""{SQL_LABELLED.replace(f'WHERE {COMPLETE}', '')}, r AS (
  SELECT id, 'missing or failed paired calculation/reference' AS reason FROM labelled WHERE NOT ({COMPLETE})
  UNION ALL SELECT id, 'reference-quality exclusion' FROM labelled WHERE reference_quality = 'questionable'
  UNION ALL SELECT id, 'reference needs review or explicit exploratory mode' FROM labelled WHERE reference_quality = 'unreviewed'
  UNION ALL SELECT id, 'reference uncertainty makes a training target ambiguous' FROM labelled
    WHERE {COMPLETE} AND reference_quality = 'reviewed'
      AND (label_surrogate IS NULL OR label_reference IS NULL OR label_total IS NULL))
SELECT COALESCE(reason, 'eligible') AS reason, COUNT(*) AS n, SUM(labelled.id)::BIGINT AS id_sum
FROM labelled LEFT JOIN r ON labelled.id = r.id GROUP BY 1""")
def _(t):
    judged = with_eligibility(S.study(t), CONFIG)
    return judged.select("id", F.explode_outer("reasons").alias("reason")).groupBy(
        F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


# rows of one customer and priority repeat the first of them, as their stored metadata says
@query("loaded_study_eligibility", f"""{SQL_LABELLED.replace(f'WHERE {COMPLETE}', '')}, marked AS (
  SELECT labelled.*, MIN(labelled.id) OVER (PARTITION BY group_id, priority) AS original FROM labelled),
r AS (
  SELECT id, 'missing or failed paired calculation/reference' AS reason FROM marked WHERE NOT ({COMPLETE})
  UNION ALL SELECT id, 'duplicate observable of ' || original FROM marked WHERE original <> id
  UNION ALL SELECT id, 'reference-quality exclusion' FROM marked WHERE reference_quality = 'questionable'
  UNION ALL SELECT id, 'reference needs review or explicit exploratory mode' FROM marked WHERE reference_quality = 'unreviewed'
  UNION ALL SELECT id, 'reference uncertainty makes a training target ambiguous' FROM marked
    WHERE {COMPLETE} AND reference_quality = 'reviewed' AND original = id
      AND (label_surrogate IS NULL OR label_reference IS NULL OR label_total IS NULL)),
placed AS (SELECT id, ROW_NUMBER() OVER (ORDER BY group_id::VARCHAR, id) - 1 AS ord FROM study)
SELECT marked.id::VARCHAR AS id, placed.ord, COALESCE(reason, 'eligible') AS reason, 'relative' AS cost_unit
FROM marked JOIN placed ON placed.id = marked.id LEFT JOIN r ON marked.id = r.id""")
def _(t):
    first = W.partitionBy("group_id", "priority")
    rows = S.study(t).withColumn("_first", F.min("id").over(first))
    text = lambda c: F.col(c).cast("string").alias(c)
    row = F.struct(
        F.col("id").alias("_place"), text("id"), text("group_id"), "mlip", "dft", "reference", "reference_quality", "reference_uncertainty",
        "high_level_value", "high_level_supported", text("decision_group"),
        F.struct(F.when(F.col("_first") != F.col("id"), F.col("_first").cast("string")).alias("duplicate_of")).alias("metadata"))
    # one document per customer
    documents = rows.groupBy(F.col("group_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    documents = documents.select("path", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "rows")).alias("text"))
    loaded = datasets.unpack_study_table(datasets.check_documents(documents))
    return with_eligibility(loaded, CONFIG).select("id", "ord", F.explode_outer("reasons").alias("reason"), "cost_unit").withColumn(
        "reason", F.coalesce("reason", F.lit("eligible")))


@query("spin_contamination", """SELECT o_orderkey, ABS(x - s * (s + 1)) AS contamination FROM (
  SELECT o_orderkey, LENGTH(o_orderpriority) AS m, (LENGTH(o_orderpriority) - 1) / 2.0::DOUBLE AS s, o_totalprice / 10000 AS x FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", C.spin_contamination(F.col("o_totalprice") / 10000, F.length("o_orderpriority")).alias("contamination"))


@query("orbital_gap", """SELECT l_orderkey, MIN(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END)
  - MAX(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END) AS gap FROM lineitem GROUP BY 1""")
def _(t):
    occupied = F.when(F.col("l_returnflag") == "N", 0.0).otherwise(2.0)
    channels = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("e"), occupied.alias("o"))).alias("c"))
    return channels.select("l_orderkey", C.orbital_gap("c.e", "c.o").alias("gap"))


@query("weighted_risk", """SELECT vec_id, (0.25::DOUBLE * abs(embedding[1]::DOUBLE) + 0.75::DOUBLE * abs(embedding[2]::DOUBLE)) / 1.0::DOUBLE AS weighted_risk
FROM embeddings""")
def _(t):
    part = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    df = t.embeddings.select("vec_id", F.create_map(F.lit("a"), part(0), F.lit("b"), part(1)).alias("features"))
    return metrics.weighted_risk(df, {"a": 0.25, "b": 0.75}, "vec_id")


@query("escalate_once", f"""WITH {S.SQL_STUDY} SELECT id, CASE WHEN cheap_screen - 0.5 >= 0.05 THEN 'run_high_level'
  WHEN risk_total - 0.5 >= 0.0025 THEN 'run_dft' ELSE 'accept_mlip' END AS decision FROM study""")
def _(t):
    return S.study(t).select("id", C.escalate_once("risk_total", "cheap_screen").alias("decision"))


@query("sigmoid", """SELECT vec_id, ROUND(CASE WHEN x >= 0 THEN 1 / (1 + EXP(-x)) ELSE EXP(x) / (1 + EXP(x)) END, 12) AS p
FROM (SELECT vec_id, embedding[1]::DOUBLE * 400 AS x FROM embeddings)""")
def _(t):
    return t.embeddings.select("vec_id", F.round(C.sigmoid(F.col("embedding")[0].cast("double") * 400), 12).alias("p"))


@query("stationary_point_audit", """SELECT vec_id, m AS imaginary_modes, m = 1 AND label <> 0 AS stationary_order_one,
  m = 1 AND label <> 0 AND label < 5 AS verified_transition_state
FROM (SELECT vec_id, label, len([x FOR x IN embedding IF x::DOUBLE * 100 < -20.0]) AS m FROM embeddings)""")
def _(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 100)
    audit = C.stationary_point_audit(scaled, F.col("label") < 5, F.col("label") != 0)
    return t.embeddings.select("vec_id", *[c.alias(n) for n, c in audit.items()])


@query("ensemble_summary", """SELECT vec_id, ROUND(AVG(x), 9) AS mean, ROUND(STDDEV_SAMP(x), 9) AS std, MAX(x) - MIN(x) AS range
FROM (SELECT vec_id, UNNEST(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def _(t):
    s = C.vector_summary("v")
    df = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return df.select("vec_id", F.round(s["mean"], 9).alias("mean"), F.round(s["std"], 9).alias("std"), s["range"].alias("range"))


# ---- digests -----------------------------------------------------------------

@query("content_digest", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS digest FROM part""")
def _(t):
    return t.part.select("p_partkey", C.content_digest("p_name", "p_size", "p_brand").alias("digest"))


@query("geometry_hash", """SELECT o_orderkey, sha256('{"charge":' || k || ',"multiplicity":1,"positions_angstrom":[' || pos || '],"symbols":[' || sym || ']}') AS geometry_hash
FROM (SELECT l_orderkey AS o_orderkey, COUNT(*) AS k, string_agg('[' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ']', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
        string_agg('"' || l_returnflag || '"', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS sym
      FROM lineitem GROUP BY 1)""")
def _(t):
    atoms = t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("a"), F.count("*").alias("k"))
    places = F.transform("a", lambda x: F.array(x["l_linenumber"].cast("long"), x["l_partkey"], x["l_suppkey"]))
    return atoms.select(F.col("l_orderkey").alias("o_orderkey"), C.geometry_hash(
        F.transform("a", lambda x: x["l_returnflag"]), places, F.col("k"), F.lit(1)).alias("geometry_hash"))


@query("table_fingerprint", """WITH h AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS d FROM orders),
s AS (SELECT COUNT(*) AS rows, SUM(('0x' || substr(d, 1, 15))::BIGINT) AS a, SUM(('0x' || substr(d, 16, 15))::BIGINT) AS b,
  SUM(('0x' || substr(d, 31, 15))::BIGINT) AS c, SUM(('0x' || substr(d, 46, 15))::BIGINT) AS e FROM h)
SELECT rows, sha256(rows || '|' || a || '|' || b || '|' || c || '|' || e) AS fingerprint FROM s""")
def _(t):
    return fingerprints.multiset_fingerprint(t.orders, ["o_orderkey", "o_custkey", "o_orderpriority"])


# ---- violations --------------------------------------------------------------

@query("validate_scalars", r"""SELECT event_id AS id, UNNEST([x FOR x IN [
  CASE WHEN NOT value >= 0 THEN 'nonnegative' END, CASE WHEN NOT value > 5 THEN 'positive' END,
  CASE WHEN NOT (value / 100 BETWEEN 0 AND 1) THEN 'probability' END,
  CASE WHEN NOT (value = FLOOR(value) AND value >= 10) THEN 'integer' END,
  CASE WHEN NOT (regexp_full_match(props, '[A-Za-z0-9][A-Za-z0-9_.:/+-]{0,255}') AND NOT contains(props, '..') AND NOT contains(props, '//')) THEN 'identifier' END
  ] IF x IS NOT NULL]) AS rule FROM events""")
def _(t):
    v = F.col("value")
    return V.validate_scalars(t.events, "event_id", nonnegative=V.nonnegative(v), positive=V.positive(v - 5),
                              probability=V.probability(v / 100), integer=V.integer_at_least(v, 10), identifier=V.identifier("props"))


@query("validate_vectors", """SELECT vec_id AS id, rule FROM (
  SELECT vec_id, UNNEST([x FOR x IN [CASE WHEN NOT (len(v) > 0) THEN 'vector' END, CASE WHEN vec_id IS NULL THEN 'matrix' END,
    CASE WHEN label = 3 THEN 'ragged' END] IF x IS NOT NULL]) AS rule
  FROM (SELECT vec_id, label, [x FOR x IN embedding IF x::DOUBLE > 0.3::DOUBLE] AS v FROM embeddings))""")
def _(t):
    long = F.filter("embedding", lambda x: x.cast("double") > 0.3)
    square = F.array(F.col("embedding"), F.reverse("embedding"))
    ragged = F.when(F.col("label") == 3, F.array(F.col("embedding"), F.slice("embedding", 1, 3))).otherwise(square)
    df = t.embeddings.withColumns({"v": long, "m": square, "r": ragged})
    return V.broken_rules(df, "vec_id", {"vector": V.vector("v"), "matrix": V.matrix("m"), "ragged": V.matrix("r")})


@query("validate_structures", """WITH a AS (
  SELECT l_orderkey AS id, COUNT(*) AS n, SUM(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 7 ELSE 8 END) AS z,
    MAX(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS odd,
    COUNT(DISTINCT (l_quantity, l_discount, l_tax)) AS places FROM lineitem GROUP BY 1)
SELECT id::VARCHAR AS id, UNNEST([x FOR x IN [CASE WHEN odd = 1 THEN 'elements' END, CASE WHEN places <> n THEN 'coincident_nuclei' END,
  CASE WHEN (z2 % 2) <> 0 THEN 'electron_count' END] IF x IS NOT NULL]) AS rule
FROM (SELECT a.*, z - COALESCE(bad, 0) * 8 AS z2 FROM a LEFT JOIN (
  SELECT l_orderkey, COUNT(*) AS bad FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1) b ON id = l_orderkey)""")
def _(t):
    symbol = F.when(F.col("l_returnflag") == "A", "H").when(F.col("l_returnflag") == "N", "N").otherwise(
        F.when(F.col("l_linestatus") == "F", "Xx").otherwise("O"))
    atoms = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(symbol.alias("s"), F.array("l_quantity", "l_discount", "l_tax").alias("p"))).alias("a"))
    return V.validate_structures(atoms.select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("a.s").alias("symbols"), F.col("a.p").alias("positions_angstrom"),
        F.lit(0).alias("charge"), F.lit(1).alias("multiplicity"), F.lit("lines").alias("source")))


@query("validate_observables", """WITH s AS (
  SELECT l_orderkey AS id, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS parts, MAX(l_linestatus = 'F') AS plus, MAX(l_linestatus = 'O') AS minus,
    MAX(l_discount = 0) AS zero, MAX(CASE WHEN l_linestatus = 'F' AND l_discount <> 0 THEN 1 ELSE 0 END) AS p, MAX(CASE WHEN l_linestatus = 'O' AND l_discount <> 0 THEN 1 ELSE 0 END) AS m
  FROM lineitem GROUP BY 1)
SELECT id::VARCHAR AS id, UNNEST([x FOR x IN [CASE WHEN n < 2 OR parts <> n THEN 'unique_terms' END,
  CASE WHEN zero THEN 'nonzero_coefficients' END, CASE WHEN p = 0 OR m = 0 THEN 'both_signs' END] IF x IS NOT NULL]) AS rule FROM s""")
def _(t):
    sign = F.when(F.col("l_linestatus") == "F", F.col("l_discount")).otherwise(-F.col("l_discount"))
    obs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("structure_id"), sign.alias("coefficient"))).alias("terms"))
    return V.validate_observables(obs.select(
        F.col("l_orderkey").cast("string").alias("id"), F.lit("g").alias("group_id"), F.lit("barrier").alias("kind"), "terms",
        F.lit(None).cast("string").alias("decision_group")))


@query("validate_references", """SELECT o_orderkey AS id, UNNEST([x FOR x IN [
  CASE WHEN o_orderpriority = '5-LOW' THEN 'unit' END, CASE WHEN o_orderstatus = 'P' THEN 'method_and_source' END,
  CASE WHEN o_totalprice > 400000 THEN 'uncertainty' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'review_note' END] IF x IS NOT NULL]) AS rule FROM orders""")
def _(t):
    p = F.col("o_orderpriority")
    return V.validate_references(t.orders.select(F.col("o_orderkey").alias("id"), F.struct(
        F.col("o_totalprice").alias("value"), F.when(p == "5-LOW", "cal").otherwise("eV").alias("unit"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("m").alias("method"), F.lit("s").alias("source"),
        F.when(p == "1-URGENT", "reviewed").otherwise("unreviewed").alias("quality"),
        (F.lit(400000.0) - F.col("o_totalprice")).alias("uncertainty"), F.lit("  ").alias("review_note")).alias("reference")))


@query("validate_calculations", f"""WITH {S.SQL_CALCULATIONS}
SELECT structure_id || '/' || method_id AS id, UNNEST([x FOR x IN [CASE WHEN status <> 'succeeded' THEN 'energy_iff_succeeded' END,
  CASE WHEN method_id = 'H' THEN 'geometry_hash' END, CASE WHEN cost > 5 THEN 'cost' END, CASE WHEN spin_contamination > 0.07 THEN 'diagnostics' END] IF x IS NOT NULL]) AS rule
FROM calculations""")
def _(t):
    df = S.calculations(t).withColumns({
        "energy": F.coalesce("energy", F.lit(1.0)), "cost": F.when(F.col("cost") > 5, -1.0).otherwise(F.col("cost")),
        "geometry_hash": F.when(F.col("method_id") == "H", F.upper("geometry_hash")).otherwise(F.col("geometry_hash")),
        "diagnostics": F.transform_values("diagnostics", lambda k, v: F.when((k == "spin_contamination") & (v > 0.07), F.lit(float("nan"))).otherwise(v))})
    # a digest of digits only survives upper-casing; none of the tables has one
    return V.validate_calculations(df)


@query("check_binary_pairs", f"""WITH {S.SQL_SCORED} SELECT doc_id AS id, UNNEST([x FOR x IN [CASE WHEN y + toxic > 1 THEN 'binary_label' END,
  CASE WHEN s * 2 > 1 THEN 'probability' END] IF x IS NOT NULL]) AS rule FROM scored""")
def _(t):
    df = S.scored_documents(t).withColumns({"lab": F.col("y") + F.col("toxic"), "sc": F.col("s") * 2})
    return V.validate_pairs(df, "doc_id", "lab", "sc", probabilities=True)


@query("validate_study_rows", f"""WITH {S.SQL_STUDY} SELECT id, UNNEST([x FOR x IN [CASE WHEN status = 'F' THEN 'cost_stages' END,
  CASE WHEN n_lines = 2 THEN 'operations' END, CASE WHEN cheap_screen > 0.9 THEN 'cheap_screen' END,
  CASE WHEN priority = '3-MEDIUM' THEN 'stage_1_names' END, CASE WHEN priority = '3-MEDIUM' THEN 'features_disjoint' END] IF x IS NOT NULL]) AS rule FROM study""")
def _(t):
    rows = S.study(t)
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, (str, float)) else x for x in kv])
    ones = m("cheap_screen", F.when(F.col("cheap_screen") > 0.9, 1.5).otherwise(F.col("cheap_screen")))
    costs = m("mlip", 0.03, "dft", 1.0, "high_level", 20.0, "screen", 0.05, "diagnostics", 0.3)
    ops = F.create_map(F.lit("dft"), m("x", F.when(F.col("n_lines") == 2, 0.9).otherwise(1.0)))
    return V.validate_study_rows(rows.select(
        "id", "group_id", "mlip", "dft", "reference", "high_level_value", "reference_quality", "reference_uncertainty", "high_level_supported",
        F.when(F.col("priority") == "3-MEDIUM", F.map_concat(ones, m("fod", 0.1))).otherwise(ones).alias("mlip_features"),
        m("fod", F.col("fod")).alias("dft_features"),
        F.when(F.col("status") == "F", F.map_filter(costs, lambda k, v: k != "screen")).otherwise(costs).alias("costs"),
        ops.alias("operations")))


@query("validate_features", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ensemble_std' WHEN p_size % 3 = 1 THEN 'fod' ELSE p_name END AS feature,
  CASE WHEN p_size % 3 = 0 THEN 'available' WHEN p_size % 3 = 1 THEN 'too_early' ELSE 'unknown' END AS verdict FROM part""")
def _(t):
    kind = F.col("p_size") % 3
    name = F.when(kind == 0, "ensemble_std").when(kind == 1, "fod").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", name.alias("feature"), feature_verdict(name, STAGE_MLIP).alias("verdict"))


@query("composition", """SELECT l_orderkey::VARCHAR AS structure_id, l_returnflag AS element, COUNT(*) AS count FROM lineitem GROUP BY 1, 2""")
def _(t):
    symbols = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_list("l_returnflag").alias("symbols"))
    return O.composition(symbols)
