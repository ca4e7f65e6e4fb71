"""Study-shaped views of the given tables, once as DataFrames and once as SQL.

Orders play the observables, their line items the species terms and measurements, customers the split and
decision groups, parts the structures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.functions.columns import hash_unit

# tolerances in the price scale of the tables
SURROGATE_TOL, REFERENCE_TOL, DECISION_TOL = 3000.0, 100000.0, 100000.0


def sql_unit(tag: str, expr: str) -> str:
    return f"(('0x' || substr(md5('{tag}|' || {expr}::VARCHAR), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def study(t) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    # millionths as longs: a sum of decimals is twice as wide in the shuffle and has a flag of its own
    millionths = lambda c: F.sum((c.cast("decimal(18,6)") * F.lit(1_000_000)).cast("long"))
    money = lambda c: (millionths(c).cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("double")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        money(price).alias("mlip"), money(price * (1 + F.col("l_tax"))).alias("dft"), F.count("*").alias("n_lines"),
        F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"), F.sum("l_quantity").alias("qty"),
        F.min("l_quantity").alias("minq"), F.max("l_tax").alias("tax"), F.min("l_discount").alias("disc"))
    many = F.col("n_lines") >= 2
    priority = F.col("o_orderpriority")
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"), F.col("o_custkey").alias("decision_group"),
        F.col("o_orderkey").alias("ord"), "mlip", "dft", F.col("o_totalprice").alias("reference"),
        F.when(priority == "5-LOW", "questionable").when(priority == "4-NOT SPECIFIED", "unreviewed")
        .otherwise("reviewed").alias("reference_quality"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 0.01).alias("reference_uncertainty"),
        F.when(many, F.col("o_totalprice") * 1.001).alias("high_level_value"),
        (priority != "3-MEDIUM").alias("high_level_supported"),
        F.when(many, (F.col("hi") - F.col("lo")) / 1000).alias("ensemble_std"),
        (F.col("qty") / F.col("n_lines")).alias("ood_distance"),
        hash_unit(F.lit("screen"), "o_orderkey").alias("cheap_screen"),
        (F.col("minq") / 10).alias("homo_lumo_gap_ev"), F.col("tax").alias("spin_contamination"),
        F.col("n_lines").cast("double").alias("scf_cycles"),
        F.when(F.col("o_orderstatus") != "O", F.col("disc") * 10).alias("fod"),
        F.when(many, hash_unit(F.lit("risk1"), "o_orderkey")).alias("risk_total"),
        F.when(many, hash_unit(F.lit("risk0"), "o_orderkey")).alias("risk_surrogate"),
        F.when(F.col("n_lines") != 3, hash_unit(F.lit("risk2"), "o_orderkey")).alias("reference_risk"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "n_lines",
    )


SQL_STUDY = f"""
study_lines AS (
  SELECT l_orderkey,
    CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,6))) AS DOUBLE) AS mlip,
    CAST(SUM(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6))) AS DOUBLE) AS dft,
    COUNT(*) AS n_lines, MAX(l_extendedprice) AS hi, MIN(l_extendedprice) AS lo, SUM(l_quantity) AS qty,
    MIN(l_quantity) AS minq, MAX(l_tax) AS tax, MIN(l_discount) AS disc
  FROM lineitem GROUP BY l_orderkey),
study AS (
  SELECT o_orderkey AS id, o_custkey AS group_id, o_custkey AS decision_group, o_orderkey AS ord, mlip, dft,
    o_totalprice AS reference,
    CASE o_orderpriority WHEN '5-LOW' THEN 'questionable' WHEN '4-NOT SPECIFIED' THEN 'unreviewed' ELSE 'reviewed' END AS reference_quality,
    CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 0.01::DOUBLE END AS reference_uncertainty,
    CASE WHEN n_lines >= 2 THEN o_totalprice * 1.001::DOUBLE END AS high_level_value,
    o_orderpriority <> '3-MEDIUM' AS high_level_supported,
    CASE WHEN n_lines >= 2 THEN (hi - lo) / 1000 END AS ensemble_std,
    qty / n_lines AS ood_distance,
    {sql_unit('screen', 'o_orderkey')} AS cheap_screen,
    minq / 10 AS homo_lumo_gap_ev, tax AS spin_contamination, n_lines::DOUBLE AS scf_cycles,
    CASE WHEN o_orderstatus <> 'O' THEN disc * 10 END AS fod,
    CASE WHEN n_lines >= 2 THEN {sql_unit('risk1', 'o_orderkey')} END AS risk_total,
    CASE WHEN n_lines >= 2 THEN {sql_unit('risk0', 'o_orderkey')} END AS risk_surrogate,
    CASE WHEN n_lines <> 3 THEN {sql_unit('risk2', 'o_orderkey')} END AS reference_risk,
    o_orderpriority AS priority, o_orderstatus AS status, n_lines
  FROM orders LEFT JOIN study_lines ON o_orderkey = l_orderkey)
"""


def with_operations(t, rows: DataFrame) -> DataFrame:
    """Study rows with costs and shared per-part operations (same part = same calculation)."""
    parts = t.lineitem.select(F.col("l_orderkey").alias("_o"), "l_partkey").repartition("_o").groupBy("_o").agg(
        F.collect_set("l_partkey").alias("_parts"))  # the few lines of an order, shuffled once
    ops = lambda kind, cost: F.map_from_entries(F.transform("_parts", lambda p: F.struct(
        F.concat(F.lit("part/"), p.cast("string"), F.lit("/" + kind)), F.lit(cost))))
    joined = rows.join(parts, F.col("id") == F.col("_o"), "left")
    n = F.size("_parts")
    has = F.col("_parts").isNotNull()
    none = F.expr("cast(map() as map<string,map<string,double>>)")
    costs = lambda per_part: F.when(has, n * F.lit(per_part)).otherwise(F.lit(per_part))
    return joined.select(
        *rows.columns,
        F.when(has, F.create_map(F.lit("mlip"), ops("mlip", 0.03), F.lit("dft"), ops("dft", 1.0))).otherwise(none).alias("operations"),
        F.create_map(F.lit("mlip"), costs(0.03), F.lit("dft"), costs(1.0), F.lit("high_level"), F.lit(20.0),
                     F.lit("screen"), F.lit(0.05), F.lit("diagnostics"), F.lit(0.3)).alias("costs"),
    )


# (id, step, op, cost): what each step of a row would buy
SQL_OPERATIONS = """
row_parts AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p FROM lineitem),
step_ops AS (
  SELECT id, 'mlip' AS step, 'part/' || p || '/mlip' AS op, 0.03::DECIMAL(28,12) AS cost FROM row_parts
  UNION ALL SELECT id, 'dft', 'part/' || p || '/dft', 1.0::DECIMAL(28,12) FROM row_parts
  UNION ALL SELECT id, 'mlip', id || '/mlip', 0.03 FROM study WHERE n_lines IS NULL
  UNION ALL SELECT id, 'dft', id || '/dft', 1.0 FROM study WHERE n_lines IS NULL
  UNION ALL SELECT id, 'high_level', id || '/high_level', 20.0 FROM study
  UNION ALL SELECT id, 'screen', id || '/screen', 0.05 FROM study
  UNION ALL SELECT id, 'reference_screen', id || '/screen', 0.05 FROM study
  UNION ALL SELECT id, 'diagnostics', id || '/diagnostics', 0.3 FROM study)
"""


def calculations(t) -> DataFrame:
    """Measurements per (part, return flag); the retail price is the high-level method ``H``."""
    per_key = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("ep"),
        F.sum("l_quantity").alias("q"), F.count("*").alias("k"), F.max("l_tax").alias("tax"))
    measured = per_key.select(
        F.col("l_partkey").cast("string").alias("structure_id"), F.col("l_returnflag").alias("method_id"),
        F.when(F.col("l_returnflag") == "R", "dft").otherwise("mlip").alias("fidelity"),
        F.when(F.col("k") < 5, "failed").otherwise("succeeded").alias("status"),
        F.when(F.col("k") >= 5, F.col("ep") / F.col("q")).alias("energy"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.03).alias("cost"),
        F.create_map(F.lit("scf_cycles"), F.col("k").cast("double"), F.lit("homo_lumo_gap_ev"), F.col("q") / 100,
                     F.lit("spin_contamination"), F.col("tax")).alias("diagnostics"))
    high = t.part.select(
        F.col("p_partkey").cast("string").alias("structure_id"), F.lit("H").alias("method_id"), F.lit("high_level").alias("fidelity"),
        F.lit("succeeded").alias("status"), F.col("p_retailprice").alias("energy"), F.lit(20.0).alias("cost"),
        F.expr("cast(map() as map<string,double>)").alias("diagnostics"))
    return measured.unionByName(high).select(
        "*", F.sha2("structure_id", 256).alias("geometry_hash"), F.lit("kcal/mol").alias("energy_unit"),
        F.lit("relative").alias("cost_unit"), F.concat(F.lit("settings-"), F.col("method_id")).alias("settings_hash"),
        F.lit("teacher").alias("teacher_id"), (F.col("fidelity") == "dft").alias("teacher_verified"))


SQL_CALCULATIONS = """
calculations AS (
  SELECT l_partkey::VARCHAR AS structure_id, l_returnflag AS method_id,
    CASE WHEN l_returnflag = 'R' THEN 'dft' ELSE 'mlip' END AS fidelity,
    CASE WHEN COUNT(*) < 5 THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN COUNT(*) >= 5 THEN CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) END AS energy,
    CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.03::DOUBLE END AS cost,
    COUNT(*)::DOUBLE AS scf_cycles, SUM(l_quantity) / 100 AS homo_lumo_gap_ev, MAX(l_tax) AS spin_contamination
  FROM lineitem GROUP BY l_partkey, l_returnflag
  UNION ALL
  SELECT p_partkey::VARCHAR, 'H', 'high_level', 'succeeded', p_retailprice, 20.0::DOUBLE, NULL, NULL, NULL FROM part)
"""


def nested_terms(t) -> DataFrame:
    """Net sign of every part in an order; orders need two terms of both signs to be observables.

    Lines meet by order once; their sums, the check and the list of an order need no further shuffle.
    """
    lines = t.lineitem.select(F.col("l_orderkey").cast("string").alias("observable_id"), "l_partkey",
                              F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("_sign"))
    net = lines.repartition("observable_id").groupBy("observable_id", "l_partkey").agg(
        F.sum("_sign").cast("double").alias("coefficient")).where("coefficient <> 0")
    term = F.struct(F.col("l_partkey").cast("int").alias("pos"), F.col("l_partkey").cast("string").alias("structure_id"), "coefficient")
    return net.groupBy("observable_id").agg(
        F.collect_list(term).alias("_t"), F.max("coefficient").alias("_hi"), F.min("coefficient").alias("_lo")).where(
        (F.size("_t") >= 2) & (F.col("_hi") > 0) & (F.col("_lo") < 0)).select("observable_id", F.array_sort("_t").alias("_t"))


def terms(t) -> DataFrame:
    """One row per term of :func:`nested_terms`."""
    return nested_terms(t).select("observable_id", F.inline("_t"))


SQL_TERMS = """
net AS (
  SELECT l_orderkey, l_partkey, SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END)::DOUBLE AS coefficient
  FROM lineitem GROUP BY 1, 2 HAVING SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END) <> 0),
good AS (
  SELECT l_orderkey FROM net GROUP BY 1
  HAVING COUNT(*) >= 2 AND MAX(coefficient) > 0 AND MIN(coefficient) < 0),
terms AS (
  SELECT l_orderkey::VARCHAR AS observable_id, l_partkey::INT AS pos, l_partkey::VARCHAR AS structure_id, coefficient
  FROM net WHERE l_orderkey IN (SELECT l_orderkey FROM good))
"""


def structures(t) -> DataFrame:
    """Parts as structures; brand 7 is given a stale geometry hash."""
    key = F.col("p_partkey").cast("string")
    return t.part.select(
        key.alias("id"), F.when(F.col("p_brand") == "Brand#7", F.lit("stale")).otherwise(F.sha2(key, 256)).alias("geometry_hash"))


SQL_STRUCTURES = """
structures AS (
  SELECT p_partkey::VARCHAR AS id, p_brand = 'Brand#7' AS stale FROM part)
"""


def observables(t) -> DataFrame:
    """Observable records with nested, position-ordered terms."""
    listed = F.transform("_t", lambda x: F.struct(x["structure_id"].alias("structure_id"), x["coefficient"].alias("coefficient")))
    reviewed = F.col("reference_quality") == "reviewed"
    return nested_terms(t).join(study(t).withColumn("_id", F.col("id").cast("string")), F.col("observable_id") == F.col("_id")).select(
        F.col("_id").alias("id"), F.concat(F.lit("customer-"), F.col("group_id")).alias("group_id"),
        F.lit("reaction_energy").alias("kind"), listed.alias("terms"),
        F.struct(
            F.col("reference").alias("value"), F.lit("kcal/mol").alias("unit"), F.lit("list price").alias("method"),
            F.col("priority").alias("source"), F.col("reference_quality").alias("quality"),
            F.col("reference_uncertainty").alias("uncertainty"), F.when(reviewed, "checked").otherwise("").alias("review_note"),
        ).alias("reference"),
        F.concat(F.lit("customer-"), F.col("decision_group")).alias("decision_group"))


def scored_documents(t) -> DataFrame:
    """(doc_id, y, s): quality label and a length score in steps of 1/100, so that many scores tie."""
    length = F.length("text").cast("long")
    score = F.expr("100 * _length div (_length + 1500)") / 100
    return t.documents.withColumn("_length", length).join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), score.alias("s"), "toxic", "lang", "source")


SQL_SCORED = """
scored AS (
  SELECT d.doc_id, quality AS y, (100 * LENGTH(text) // (LENGTH(text) + 1500)) / 100 AS s, toxic, lang, source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def document_entities(t) -> DataFrame:
    """(row_id, entity): documents and their lines that are not empty."""
    lines = t.documents.select(F.col("doc_id").alias("row_id"), F.explode(F.split("text", "\n")).alias("line"))
    full = lines.where(F.length("line") > 0).select("row_id", F.md5("line").alias("entity"))
    return full.unionByName(t.documents.select(F.col("doc_id").alias("row_id"), F.lit(None).cast("string").alias("entity")))
