"""Metrics, ordered scans, conformal, bootstrap and pairwise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.operators import features, metrics, ordered, pairs, statistics
from tierlens.plans.lineage import cut_lineage

from . import views as S
from .basics import COMPLETE, SQL_LABELLED, complete, labelled
from .registry import query


def rounded(df, digits=9):
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


SQL_AUROC = """SELECT {k} ROUND(CASE WHEN p > 0 AND t > p THEN (ranksum - p * (p + 1) / 2) / (p * (t - p)) END, 9) AS auroc FROM (
  SELECT {k} SUM(pos * (upto - n + (n + 1) / 2.0::DOUBLE)) AS ranksum, SUM(pos)::DOUBLE AS p, SUM(n)::DOUBLE AS t FROM (
    SELECT {k} s, SUM(y) AS pos, COUNT(*) AS n, SUM(COUNT(*)) OVER ({part} ORDER BY s) AS upto FROM {src} GROUP BY {k} s) {g})"""
SQL_AP = """SELECT {k} ROUND(SUM(pos * (tp / upto)) / NULLIF(SUM(pos), 0), 9) AS average_precision FROM (
    SELECT {k} s, SUM(y) AS pos, SUM(SUM(y)) OVER ({part} ORDER BY s DESC)::DOUBLE AS tp, SUM(COUNT(*)) OVER ({part} ORDER BY s DESC) AS upto
    FROM {src} GROUP BY {k} s) {g}"""


def sql_auroc(src, key=None):
    return SQL_AUROC.format(k=f"{key}," if key else "", part=f"PARTITION BY {key}" if key else "", src=src, g=f"GROUP BY {key}" if key else "")


def sql_ap(src, key=None):
    return SQL_AP.format(k=f"{key}," if key else "", part=f"PARTITION BY {key}" if key else "", src=src, g=f"GROUP BY {key}" if key else "")


@query("auroc", f"WITH {S.SQL_SCORED} {sql_auroc('scored')}")
def _(t):
    return rounded(ordered.auroc(S.scored_documents(t), "y", "s"))


@query("average_precision", f"WITH {S.SQL_SCORED} {sql_ap('scored')}")
def _(t):
    return rounded(ordered.average_precision(S.scored_documents(t), "y", "s"))


@query("risk_coverage", f"""WITH {S.SQL_SCORED}, c AS (
  SELECT s, SUM(SUM(y)) OVER (ORDER BY s)::DOUBLE AS lost, SUM(COUNT(*)) OVER (ORDER BY s) AS accepted, SUM(COUNT(*)) OVER () AS total FROM scored GROUP BY s)
SELECT ROUND(accepted / total, 9) AS coverage, ROUND(lost / accepted, 9) AS risk, ROUND(s, 9) AS threshold, accepted::BIGINT AS accepted FROM c""")
def _(t):
    return rounded(ordered.risk_coverage(S.scored_documents(t), "y", "s"))


@query("pareto_frontier", """SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (
  SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))""")
def _(t):
    return ordered.pareto_frontier(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("pareto_orders", f"""WITH {S.SQL_STUDY}, p AS (SELECT id, dft AS cost, reference AS risk FROM study WHERE dft IS NOT NULL),
m AS (SELECT *, MIN(risk) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT id, cost, risk FROM m WHERE before IS NULL OR risk < before""")
def _(t):
    pts = S.study(t).where("dft is not null").select("id", F.col("dft").alias("cost"), F.col("reference").alias("risk"))
    return ordered.pareto_frontier(pts, "cost", "risk")


@query("exact_quantiles", """SELECT l_returnflag, COUNT(*) AS n, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  ROUND(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(ordered.exact_quantiles(t.lineitem, "l_extendedprice", {"median": 0.5, "high": 0.975}, ["l_returnflag"]), 6)


@query("regression_report", f"""WITH {S.SQL_STUDY}, e AS (
  SELECT 'mlip_vs_dft' AS pair, mlip - dft AS e FROM study WHERE {COMPLETE}
  UNION ALL SELECT 'dft_vs_reference', dft - reference FROM study WHERE {COMPLETE}
  UNION ALL SELECT 'mlip_vs_reference', mlip - reference FROM study WHERE {COMPLETE})
SELECT pair, COUNT(*) AS n, ROUND(AVG(ABS(e)), 4) AS mae, ROUND(SQRT(AVG(e * e)), 4) AS rmse, ROUND(AVG(e), 4) AS bias, ROUND(MAX(ABS(e)), 4) AS max_abs FROM e GROUP BY pair""")
def _(t):
    pairs_ = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("p"), F.col(b).alias("r"))
                                 for a, b in (("mlip", "dft"), ("dft", "reference"), ("mlip", "reference"))]))
    return rounded(metrics.regression_report(complete(t).select(pairs_.alias("x")).select("x.*"), "p", "r", ["pair"]), 4)


@query("brier", f"WITH {S.SQL_SCORED} SELECT lang, ROUND(AVG((s - y) * (s - y)), 9) AS brier FROM scored GROUP BY lang")
def _(t):
    return rounded(metrics.brier_score(S.scored_documents(t), "y", "s", ["lang"]))


SQL_BINS = "LEAST(FLOOR(s * 10), 9)::INT"


@query("calibration_bins", f"""WITH {S.SQL_SCORED}, b AS (
  SELECT {SQL_BINS} AS bin, COUNT(*) AS c, AVG(s) AS p, AVG(y) AS f FROM scored GROUP BY 1)
SELECT r.bin::INT AS bin, r.bin / 10.0::DOUBLE AS lower, (r.bin + 1) / 10.0::DOUBLE AS upper, COALESCE(c, 0) AS count,
  ROUND(p, 9) AS mean_probability, ROUND(f, 9) AS event_fraction FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin""")
def _(t):
    df = metrics.calibration_bins(S.scored_documents(t), "y", "s")
    return df.withColumns({c: F.round(c, 9) for c in ("mean_probability", "event_fraction")})


@query("classification_report", f"""WITH {S.SQL_SCORED}, b AS (SELECT {SQL_BINS} AS bin, COUNT(*) AS c, ABS(AVG(s) - AVG(y)) AS g FROM scored GROUP BY 1),
c AS (SELECT COUNT(*) AS n, SUM(y)::BIGINT AS positives, ROUND(AVG(y), 9) AS prevalence, ROUND(AVG((s - y) * (s - y)), 9) AS brier,
  COUNT(*) FILTER (s >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (s >= 0.5 AND y = 0) AS fp, COUNT(*) FILTER (s < 0.5 AND y = 1) AS fn, COUNT(*) FILTER (s < 0.5 AND y = 0) AS tn FROM scored)
SELECT n, positives, prevalence, (SELECT auroc FROM ({sql_auroc('scored')})) AS auroc, (SELECT average_precision FROM ({sql_ap('scored')})) AS average_precision, brier,
  (SELECT ROUND(SUM(c * g) / SUM(c), 9) FROM b) AS ece, tp, fp, fn, tn, ROUND(tp / NULLIF(tp + fp, 0), 9) AS precision, ROUND(tp / NULLIF(tp + fn, 0), 9) AS recall FROM c""")
def _(t):
    return rounded(metrics.classification_report(S.scored_documents(t), "y", "s"))


@query("stratified_classification", f"""WITH {S.SQL_SCORED}, a AS ({sql_auroc('scored', 'lang')}), p AS ({sql_ap('scored', 'lang')})
SELECT s.lang, COUNT(*) AS n, SUM(y)::BIGINT AS positives, auroc, average_precision, ROUND(AVG((s - y) * (s - y)), 9) AS brier
FROM scored s JOIN a ON a.lang = s.lang JOIN p ON p.lang = s.lang GROUP BY s.lang, auroc, average_precision""")
def _(t):
    return rounded(metrics.classification_report(S.scored_documents(t), "y", "s", keys=["lang"])).select(
        "lang", "n", "positives", "auroc", "average_precision", "brier")


@query("stratified_report", f"""WITH {S.SQL_STUDY}, e AS (SELECT priority, status, mlip - reference AS e FROM study WHERE {COMPLETE})
SELECT CASE WHEN GROUPING(priority) = 0 THEN 'priority' WHEN GROUPING(status) = 0 THEN 'status' ELSE 'all' END AS stratum,
  COALESCE(priority, status, 'all') AS level, COUNT(*) AS n, ROUND(AVG(ABS(e)), 4) AS mae, ROUND(SQRT(AVG(e * e)), 4) AS rmse, ROUND(AVG(e), 4) AS bias
FROM e GROUP BY GROUPING SETS ((), (priority), (status))""")
def _(t):
    return rounded(metrics.stratified_regression(complete(t), "mlip", "reference", ["priority", "status"]), 4)


@query("raw_uq_report", f"""{SQL_LABELLED}, l AS (
  SELECT 'surrogate' AS target, ensemble_std AS s, label_surrogate AS y FROM labelled WHERE ensemble_std IS NOT NULL AND label_surrogate IS NOT NULL
  UNION ALL SELECT 'reference', ensemble_std, label_reference FROM labelled WHERE ensemble_std IS NOT NULL AND label_reference IS NOT NULL
  UNION ALL SELECT 'total', ensemble_std, label_total FROM labelled WHERE ensemble_std IS NOT NULL AND label_total IS NOT NULL),
a AS ({sql_auroc('l', 'target')}), p AS ({sql_ap('l', 'target')})
SELECT l.target, COUNT(*) AS n, auroc, average_precision FROM l JOIN a ON a.target = l.target JOIN p ON p.target = l.target GROUP BY l.target, auroc, average_precision""")
def _(t):
    return rounded(metrics.raw_score_report(labelled(t), "ensemble_std", {n: f"label_{n}" for n in ("surrogate", "reference", "total")}))


@query("class_balance", f"""{SQL_LABELLED}, l AS (SELECT 'surrogate' AS target, status, label_surrogate AS y FROM labelled
  UNION ALL SELECT 'reference', status, label_reference FROM labelled UNION ALL SELECT 'total', status, label_total FROM labelled)
SELECT target, status, COUNT(y) AS n, SUM(y)::BIGINT AS positives, MIN(y) = MAX(y) AS single_class FROM l GROUP BY target, status""")
def _(t):
    return metrics.class_balance(labelled(t), "status", {n: f"label_{n}" for n in ("surrogate", "reference", "total")})


@query("mean_cost", "SELECT l_returnflag, ROUND(AVG(l_quantity), 9) AS mean_cost FROM lineitem GROUP BY 1")
def _(t):
    return rounded(metrics.mean_cost(t.lineitem, "l_quantity", ["l_returnflag"]))


@query("group_conformal_fit", f"""WITH {S.SQL_STUDY}, w AS (SELECT group_id, MAX(ABS(dft - reference)) AS worst FROM study WHERE {COMPLETE} GROUP BY 1),
g AS (SELECT COUNT(*) AS groups, CEIL((COUNT(*) + 1) * (1 - 0.1::DOUBLE))::BIGINT AS rank FROM w)
SELECT groups, rank, (SELECT worst FROM w ORDER BY worst LIMIT 1 OFFSET (SELECT rank - 1 FROM g)) AS quantile, rank <= groups AS bounded FROM g""")
def _(t):
    rows = complete(t).withColumn("residual", F.col("dft") - F.col("reference"))
    return metrics.fit_conformal(rows, "residual", "group_id", 0.1)


@query("group_conformal_interval", f"""WITH {S.SQL_STUDY}, w AS (SELECT group_id, MAX(ABS(dft - reference)) AS worst FROM study WHERE {COMPLETE} GROUP BY 1),
q AS (SELECT worst AS q FROM w ORDER BY worst LIMIT 1 OFFSET (SELECT CEIL((COUNT(*) + 1) * (1 - 0.1::DOUBLE))::BIGINT - 1 FROM w))
SELECT id, dft - q AS lower, dft + q AS upper, TRUE AS bounded FROM study, q WHERE {COMPLETE}""")
def _(t):
    rows = complete(t).withColumn("residual", F.col("dft") - F.col("reference"))
    q = metrics.fit_conformal(rows, "residual", "group_id", 0.1).first()
    return metrics.conformal_interval(rows, "dft", q["quantile"]).select("id", "lower", "upper", "bounded")


SEP = " || '|' || "


def sql_draws(seed: int, repetitions: int) -> str:
    """The operator's hash draws over groups numbered in md5 order: a bucket of 1,024 first, then a group in it."""
    pick = lambda *parts: f"('0x' || substr(md5('{seed}|' || {SEP.join(parts)}), 1, 15))::BIGINT"
    return f"""k AS (SELECT COUNT(*) AS n FROM per),
fallen AS (SELECT r.r AS replicate, {pick('r.r', 'd.d')} % n // 1024 AS bucket, ANY_VALUE(n) AS n, COUNT(*) AS m
  FROM k, range({repetitions}) r(r), LATERAL (SELECT UNNEST(range(n)) AS d) d GROUP BY 1, 2),
draws AS (SELECT replicate, bucket * 1024 + ('0x' || substr(md5('{seed}|' || {SEP.join(('replicate', 'bucket', '(j.j // 4)'))}), 8 * (j.j % 4) + 1, 8))::BIGINT
    % LEAST(1024, n - bucket * 1024) AS idx
  FROM fallen, LATERAL (SELECT UNNEST(range(m)) AS j) j)"""


def sql_bootstrap(values: str, repetitions: int) -> str:
    return f"""vals AS ({values}), per AS (
  SELECT g, SUM(v) AS sv, COUNT(v) AS cv, ROW_NUMBER() OVER (ORDER BY md5(g::VARCHAR)) - 1 AS idx FROM vals GROUP BY g),
{sql_draws(42, repetitions)},
reps AS (SELECT replicate, SUM(sv) / SUM(cv) AS statistic FROM draws JOIN per USING (idx) GROUP BY replicate)"""


SQL_PAIRED = f"SELECT group_id AS g, ABS(mlip - reference) - ABS(dft - reference) AS v FROM study WHERE {COMPLETE}"


@query("cluster_bootstrap", f"""WITH {S.SQL_STUDY}, {sql_bootstrap(SQL_PAIRED, 1000)}
SELECT ROUND((SELECT AVG(v) FROM vals), 4) AS estimate, ROUND(quantile_cont(statistic, 0.025::DOUBLE), 4) AS lower,
  ROUND(quantile_cont(statistic, 0.975::DOUBLE), 4) AS upper, 0.95::DOUBLE AS confidence, (SELECT n FROM k) AS groups, COUNT(*) AS repetitions FROM reps""")
def _(t):
    rows = complete(t).withColumn("delta", F.abs(F.col("mlip") - F.col("reference")) - F.abs(F.col("dft") - F.col("reference")))
    return rounded(metrics.cluster_bootstrap(rows, "delta", "group_id", seed=42), 4)


@query("cluster_bootstrap_statistic", f"""WITH {S.SQL_STUDY}, vals AS ({SQL_PAIRED}), per AS (
  SELECT g, ROW_NUMBER() OVER (ORDER BY md5(g::VARCHAR)) - 1 AS idx FROM vals GROUP BY g), {sql_draws(7, 100)}
SELECT replicate, ROUND(SUM(v * v) / COUNT(*) / 1000000, 4) AS statistic FROM draws JOIN per USING (idx) JOIN vals USING (g) GROUP BY replicate""")
def _(t):
    rows = complete(t).withColumn("delta", F.abs(F.col("mlip") - F.col("reference")) - F.abs(F.col("dft") - F.col("reference")))
    mean_square = lambda v, w: F.sum(w * v * v) / F.sum(w) / 1_000_000
    return rounded(metrics.bootstrap_replicates(rows, "delta", "group_id", 100, 7, mean_square), 4)


@query("bootstrap_weighted_median", f"""WITH {S.SQL_STUDY}, vals AS (SELECT group_id AS g, scf_cycles AS v FROM study WHERE {COMPLETE}), per AS (
  SELECT g, ROW_NUMBER() OVER (ORDER BY md5(g::VARCHAR)) - 1 AS idx FROM vals GROUP BY g), {sql_draws(7, 40)}
SELECT replicate, quantile_disc(v, 0.6::DOUBLE) AS statistic FROM draws JOIN per USING (idx) JOIN vals USING (g) GROUP BY replicate""")
def _(t):
    return metrics.bootstrap_replicates(complete(t), "scf_cycles", "group_id", 40, 7, statistics.WeightedQuantile(0.6))


@query("weighted_median", """WITH per AS (SELECT l_returnflag, l_discount AS v, SUM(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
upto AS (SELECT *, SUM(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS below, SUM(w) OVER (PARTITION BY l_returnflag) AS whole FROM per)
SELECT l_returnflag, MIN(v) AS statistic FROM upto WHERE 2 * below >= whole GROUP BY 1""")
def _(t):
    return statistics.aggregate_statistic(t.lineitem, ["l_returnflag"], "l_discount", statistics.WeightedQuantile(), "l_quantity")


# ---- pairwise ----------------------------------------------------------------

@query("decision_pairs", f"""WITH {S.SQL_STUDY}, p AS (
  SELECT a.decision_group, a.mlip - b.mlip AS c, a.reference - b.reference AS r, COALESCE(a.reference_uncertainty, 0) + COALESCE(b.reference_uncertainty, 0) AS u
  FROM study a JOIN study b ON a.decision_group = b.decision_group AND a.ord < b.ord),
s AS (SELECT decision_group, COUNT(*) FILTER (c IS NOT NULL AND ABS(r) > u) AS resolved, COUNT(*) FILTER (c IS NULL OR ABS(r) <= u) AS unresolved,
  COUNT(*) FILTER ((c > 0 AND r > u) OR (c < 0 AND r < -u)) AS correct FROM p GROUP BY 1)
SELECT g.decision_group, g.n, COALESCE(resolved, 0) AS resolved, COALESCE(unresolved, 0) AS unresolved, COALESCE(correct, 0) AS correct,
  ROUND(correct / NULLIF(resolved, 0), 9) AS ordering_accuracy
FROM (SELECT decision_group, COUNT(*) AS n FROM study GROUP BY 1) g LEFT JOIN s USING (decision_group)""")
def _(t):
    return rounded(pairs.decision_pairs(S.study(t), "decision_group", "mlip"))


@query("ordering_accuracy", f"""WITH {S.SQL_STUDY}, d AS (SELECT group_id, ord, mlip, dft FROM study WHERE {COMPLETE}), p AS (
  SELECT a.group_id, CASE WHEN ABS(a.mlip - b.mlip) <= 1000.5 THEN 0 ELSE SIGN(a.mlip - b.mlip) END AS c, CASE WHEN ABS(a.dft - b.dft) <= 1000.5 THEN 0 ELSE SIGN(a.dft - b.dft) END AS r
  FROM d a JOIN d b ON a.group_id = b.group_id AND a.ord < b.ord),
s AS (SELECT group_id, COUNT(*) AS pairs, COUNT(*) FILTER (c = r) AS preserved FROM p GROUP BY 1)
SELECT g.group_id, g.n, COALESCE(pairs, 0) AS pairs, COALESCE(preserved, 0) AS preserved, ROUND(COALESCE(preserved / NULLIF(pairs, 0), 1.0), 9) AS ordering_accuracy,
  COALESCE(preserved, 0) = COALESCE(pairs, 0) AS ordering_preserved
FROM (SELECT group_id, COUNT(*) AS n FROM d GROUP BY 1) g LEFT JOIN s USING (group_id)""")
def _(t):
    return rounded(pairs.ordering_accuracy(complete(t), "group_id", "mlip", "dft", 1000.5))


# ---- preprocessing and distance ----------------------------------------------

FEATURES = ("ensemble_std", "ood_distance", "cheap_screen", "homo_lumo_gap_ev", "spin_contamination", "scf_cycles", "fod")
SQL_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value FROM study" for f in FEATURES)


@query("fit_preprocessor", f"""WITH {S.SQL_STUDY}, l AS ({SQL_LONG}), m AS (SELECT feature, COUNT(*) AS rows, COUNT(value) AS known, quantile_cont(value, 0.5::DOUBLE) AS median FROM l GROUP BY 1)
SELECT m.feature, rows, known, ROUND(COALESCE(median, 0), 6) AS median, ROUND(AVG(COALESCE(value, median, 0)), 6) AS mean,
  ROUND(CASE WHEN STDDEV_POP(COALESCE(value, median, 0)) < 1e-12 THEN 1 ELSE STDDEV_POP(COALESCE(value, median, 0)) END, 6) AS scale, known = 0 AS all_missing
FROM l JOIN m ON l.feature = m.feature GROUP BY m.feature, rows, known, median""")
def _(t):
    return rounded(features.preprocessor_table(S.study(t).select(*FEATURES), FEATURES), 6)


SQL_STATS = ", ".join(
    f"quantile_cont({f}::DOUBLE, 0.5::DOUBLE) AS m_{f}" for f in FEATURES)


@query("apply_preprocessor", f"""WITH {S.SQL_STUDY}, med AS (SELECT {SQL_STATS} FROM study),
st AS (SELECT {', '.join(f'ANY_VALUE(m_{f}) AS m_{f}, AVG(COALESCE({f}, m_{f})) AS a_{f}, STDDEV_POP(COALESCE({f}, m_{f})) AS d_{f}' for f in FEATURES)} FROM study, med)
SELECT id, {', '.join(f'ROUND((COALESCE({f}, m_{f}) - a_{f}) / d_{f}, 6) AS z_{f}, ({f} IS NULL)::INT::DOUBLE AS missing_{f}' for f in FEATURES)} FROM study, st""")
def _(t):
    rows = cut_lineage(S.study(t).select("id", *FEATURES))
    fitted = features.fit_preprocessor(rows, FEATURES, 1)
    out = fitted.apply(rows)
    return out.select("id", *[F.round(f"z_{f}", 6).alias(f"z_{f}") for f in FEATURES], *[f"missing_{f}" for f in FEATURES])


SQL_Z = """x AS (SELECT vec_id, UNNEST(range(64))::INT AS i, UNNEST(embedding)::DOUBLE AS v FROM embeddings),
st AS (SELECT i, AVG(v) AS m, STDDEV_POP(v) AS s FROM x GROUP BY i),
z AS (SELECT vec_id, x.i, (v - m) / s AS z FROM x JOIN st ON x.i = st.i)"""


@query("mahalanobis_fit", f"""WITH {SQL_Z} SELECT a.i, b.i AS j, ROUND(SUM(a.z * b.z) / (COUNT(*) - 1), 6) AS covariance
FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2""")
def _(t):
    model = features.fit_distance(t.embeddings, "embedding")
    return rounded(features.covariance_table(t.embeddings, model), 6)


# the inverse by Gauss-Jordan elimination, one pivot per step
SQL_DISTANCE = f"""WITH RECURSIVE {SQL_Z},
cov AS (SELECT a.i, b.i AS j, SUM(a.z * b.z) / (COUNT(*) - 1) + CASE WHEN a.i = b.i THEN 0.1::DOUBLE ELSE 0 END AS c FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY 1, 2),
start AS (SELECT list(line ORDER BY i) AS m FROM (
  SELECT i, list_concat(list(c ORDER BY j), list_transform(range(64), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS line FROM cov GROUP BY i)),
steps(k, m) AS (SELECT 0, m FROM start UNION ALL
  SELECT k + 1, list_transform(range(64), lambda r: CASE WHEN r = k THEN p ELSE list_transform(range(128), lambda c: m[r + 1][c + 1] - m[r + 1][k + 1] * p[c + 1]) END)
  FROM (SELECT k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) AS p FROM steps WHERE k < 64)),
inverse AS (SELECT i.r AS i, j.r AS j, m[i.r + 1][j.r + 65] AS p FROM steps, range(64) i(r), range(64) j(r) WHERE k = 64)
SELECT a.vec_id, ROUND(SQRT(SUM(a.z * p * b.z)), 6) AS ood_distance FROM z a JOIN inverse v ON v.i = a.i JOIN z b ON b.vec_id = a.vec_id AND b.i = v.j GROUP BY 1"""


@query("mahalanobis_score", SQL_DISTANCE)
def _(t):
    model = features.fit_distance(t.embeddings, "embedding")
    return rounded(features.distance_scores(t.embeddings.select("vec_id", "embedding"), "embedding", model).select("vec_id", "ood_distance"), 6)
