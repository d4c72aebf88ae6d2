"""Queries over prediction tables."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.evaluation import bootstrap as B
from boutline.evaluation import metrics as M
from boutline.fixtures import with_views
from boutline.ml import training
from boutline.operators.encoding import fold_of
from boutline.roles import ROLE_PREFIX  # noqa: F401


def preds(spark, sf):
    p = fx.predictions_long(spark, sf)
    return p.withColumn("split", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "train").otherwise("val"))


_P = """, pr AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'train' ELSE 'val' END AS split, CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END AS yp,
 CAST(p > 0e0 AS INT) + CAST(p > 1 * 1e-1 AS INT) + CAST(p > 2 * 1e-1 AS INT) + CAST(p > 3 * 1e-1 AS INT) + CAST(p > 4 * 1e-1 AS INT) + CAST(p > 5 * 1e-1 AS INT) + CAST(p > 6 * 1e-1 AS INT)
 + CAST(p > 7 * 1e-1 AS INT) + CAST(p > 8 * 1e-1 AS INT) + CAST(p > 9 * 1e-1 AS INT) AS bin FROM fx_long),
cf AS (SELECT model, split, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(yp * y_true) AS DOUBLE) AS tp, CAST(SUM(yp * (1 - y_true)) AS DOUBLE) AS fp, CAST(SUM((1 - yp) * (1 - y_true)) AS DOUBLE) AS tn, CAST(SUM((1 - yp) * y_true) AS DOUBLE) AS fn,
 AVG(-CASE WHEN y_true = 1 THEN LN(p) ELSE LN(1e0 - p) END) AS ll, AVG((p - y_true) * (p - y_true)) AS br FROM pr GROUP BY 1, 2),
rt AS (SELECT *, (tp + tn) / n AS accuracy, tp / (tp + fp) AS prec, tp / (tp + fn) AS recall, 2e0 * tp / (2e0 * tp + fp + fn) AS f1, tn / (tn + fp) AS spec,
 (tp * tn - fp * fn) / SQRT((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe FROM cf),
sc AS (SELECT model, split, p, CAST(SUM(y_true) AS DOUBLE) AS pos, CAST(SUM(1 - y_true) AS DOUBLE) AS neg FROM pr GROUP BY 1, 2, 3),
sb AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below FROM sc),
au AS (SELECT model, split, SUM(pos * (below + neg / 2e0)) / (SUM(pos) * SUM(neg)) AS auc FROM sb GROUP BY 1, 2),
bn AS (SELECT model, split, bin, COUNT(*) AS k, AVG(p) AS mp, AVG(CAST(y_true AS DOUBLE)) AS my FROM pr GROUP BY 1, 2, 3),
ce AS (SELECT model, split, SUM(k * ABS(mp - my)) / SUM(k) AS ece, MAX(ABS(mp - my)) AS mce FROM bn GROUP BY 1, 2),
rep AS (SELECT rt.*, auc, ece, mce, (accuracy - pe) / (1e0 - pe) AS kappa, auc * 3e-1 + 25e-2 / (1e0 + ll) + 2e-1 * (1e0 - br) + 15e-2 * (1e0 - ece) + 1e-1 * f1 AS composite,
 25e-2 * auc + 2e-1 / (1e0 + ll) + 15e-2 * (1e0 - br) + 1e-1 * (1e0 - ece) + 1e-1 * f1 + 1e-1 * (mcc + 1e0) / 2e0 + 1e-1 * ((accuracy - pe) / (1e0 - pe) + 1e0) / 2e0 AS composite7
 FROM rt JOIN au USING (model, split) JOIN ce USING (model, split))
"""
KEYS = ["model", "split"]


def _q(sql):
    return with_views(_P + sql, "fx_long")


@query(
    "m1_confusion_metrics",
    _q("""SELECT model, split, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, ROUND(accuracy, 6) AS accuracy, ROUND(prec, 6) AS precision,
 ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, ROUND(spec, 6) AS specificity, ROUND((recall + spec) / 2e0, 6) AS balanced_accuracy, ROUND(mcc, 6) AS mcc, ROUND(kappa, 6) AS kappa FROM rep"""),
)
def m1(spark, sf):
    d = M.confusion_metrics(preds(spark, sf), KEYS)
    return d.select(*KEYS, "tp", "fp", "tn", "fn", *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc", "kappa")])


@query("m2_auc", _q("SELECT model, split, ROUND(auc, 6) AS auc FROM au"))
def m2(spark, sf):
    return M.auc(preds(spark, sf), KEYS).select(*KEYS, r6("auc"))


@query("m3_log_loss_brier", _q("SELECT model, split, ROUND(ll, 6) AS log_loss, ROUND(br, 6) AS brier FROM cf"))
def m3(spark, sf):
    return M.log_loss_brier(preds(spark, sf), KEYS).select(*KEYS, r6("log_loss"), r6("brier"))


@query("m4_calibration_error", _q("SELECT model, split, ROUND(ece, 6) AS ece, ROUND(mce, 6) AS mce FROM ce"))
def m4(spark, sf):
    return M.calibration_error(preds(spark, sf), KEYS).select(*KEYS, r6("ece"), r6("mce"))


@query("m5_reliability", _q("SELECT model, split, bin, k AS rows, ROUND(mp, 6) AS mean_p, ROUND(my, 6) AS positive_rate FROM bn WHERE bin > 0"))
def m5(spark, sf):
    return M.reliability(preds(spark, sf), KEYS).select(*KEYS, "bin", "rows", r6("mean_p"), r6("positive_rate"))


@query(
    "m7_net_benefit",
    _q("""SELECT model, i AS threshold_pct, ROUND(SUM(CASE WHEN p >= i / 1e2 THEN y_true ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) - SUM(CASE WHEN p >= i / 1e2 THEN 1 - y_true ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) * (i / 1e2) / (1e0 - i / 1e2), 6) AS net_benefit,
 ROUND(AVG(CAST(y_true AS DOUBLE)) - (1e0 - AVG(CAST(y_true AS DOUBLE))) * (i / 1e2) / (1e0 - i / 1e2), 6) AS treat_all, 0e0 AS treat_none FROM pr, (SELECT CAST(UNNEST(range(1, 100)) AS INT) AS i) GROUP BY model, i"""),
)
def m7(spark, sf):
    return M.net_benefit(preds(spark, sf), ["model"]).select("model", "threshold_pct", r6("net_benefit"), r6("treat_all"), "treat_none")


@query("m8_composite", _q("SELECT model, split, ROUND(composite, 6) AS composite, ROUND(composite7, 6) AS composite7 FROM rep"))
def m8(spark, sf):
    return M.report(preds(spark, sf), KEYS).select(*KEYS, r6("composite"), r6("composite7"))


@query(
    "m9_mcnemar",
    with_views(
        """, o AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'train' ELSE 'val' END AS split, CASE WHEN CAST(p_a >= 5e-1 AS INT) = y_true THEN 1 ELSE 0 END AS a, CASE WHEN CAST(p_b >= 5e-1 AS INT) = y_true THEN 1 ELSE 0 END AS b FROM fx_preds),
c AS (SELECT split, COUNT(*) FILTER (WHERE a = 1 AND b = 0) AS b, COUNT(*) FILTER (WHERE a = 0 AND b = 1) AS c FROM o GROUP BY split)
SELECT split, b, c, ROUND((ABS(b - c) - 1) * (ABS(b - c) - 1) / CAST(b + c AS DOUBLE), 6) AS statistic FROM c""",
        "fx_preds",
    ),
)
def m9(spark, sf):
    p = fx.predictions(spark, sf).withColumn("split", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "train").otherwise("val"))
    return M.mcnemar(p, "p_a", "p_b", ["split"]).select("split", "b", "c", r6("statistic"))


_CUTS = " + ".join(f"CAST(u >= '{c}' AS INT)" for c in M.poisson_cuts())
_ROWS = f""", bw AS (SELECT model, p, y_true, g * 8 + i AS replicate, substr(md5(CAST(event_id AS VARCHAR) || '-' || CAST(g AS VARCHAR)), 4 * i + 1, 4) AS u
  FROM fx_long, (SELECT UNNEST([0, 1, 2]) AS g), (SELECT UNNEST([0, 1, 2, 3, 4, 5, 6, 7]) AS i) WHERE g * 8 + i < 20),
bx AS (SELECT model, replicate, p, y_true, {_CUTS} AS w FROM bw),
bc AS (SELECT model, replicate, p, CAST(SUM(w * y_true) AS DOUBLE) AS pos, CAST(SUM(w * (1 - y_true)) AS DOUBLE) AS neg FROM bx GROUP BY 1, 2, 3),
bb AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, replicate ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below FROM bc),
br AS (SELECT model, replicate, SUM(CASE WHEN p >= 5e-1 THEN pos ELSE neg END) / SUM(pos + neg) AS accuracy, SUM(pos * (1e0 - p) * (1e0 - p) + neg * p * p) / SUM(pos + neg) AS brier,
 SUM(pos * (below + neg / 2e0)) / (SUM(pos) * SUM(neg)) AS auc FROM bb GROUP BY 1, 2)
"""


# Weights of score cells: the same numbers from the same hashes as evaluation.bootstrap.
_CELLS = f""", bk AS (SELECT n, k, SUM(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS c FROM (SELECT UNNEST(range(1, {B.TABLE_ROWS + 1})) AS n), (SELECT UNNEST(range(0, {2 * B.TABLE_ROWS + 41})) AS k) WHERE k < 2 * n + 41),
bt AS (SELECT n, list(c ORDER BY k) AS cdf FROM bk GROUP BY n),
ba AS (SELECT model, p, CAST(SUM(y_true) AS BIGINT) AS n1, CAST(SUM(1 - y_true) AS BIGINT) AS n0 FROM fx_long GROUP BY 1, 2),
bi AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY p) - 1 AS cell FROM ba),
bl AS (SELECT model, p, cell, 1 AS y, n1 AS n FROM bi UNION ALL SELECT model, p, cell, 0, n0 FROM bi),
bh AS (SELECT *, md5(model || '-' || CAST(cell AS VARCHAR) || '-' || CAST(y AS VARCHAR) || '-' || CAST(r // 2 AS VARCHAR)) AS h FROM bl, (SELECT UNNEST(range(0, {{r}})) AS r) WHERE n > 0),
bu AS (SELECT *, (CAST('0x' || substr(h, CAST(16 * (r % 2) + 1 AS BIGINT), 8) AS BIGINT) + 5e-1) / 4294967296e0 AS u, (CAST('0x' || substr(h, CAST(16 * (r % 2) + 9 AS BIGINT), 8) AS BIGINT) + 5e-1) / 4294967296e0 AS v FROM bh),
bx AS (SELECT bu.model, r AS replicate, p, y, CASE WHEN bu.n <= {B.TABLE_ROWS} THEN len([c FOR c IN cdf IF c <= u]) ELSE greatest(0, floor(bu.n + sqrt(bu.n) * sqrt(-2 * ln(u)) * cos(2 * pi() * v) + 5e-1)) END AS w FROM bu LEFT JOIN bt ON bt.n = bu.n),
bc AS (SELECT model, replicate, p, CAST(SUM(w * y) AS DOUBLE) AS pos, CAST(SUM(w * (1 - y)) AS DOUBLE) AS neg FROM bx GROUP BY 1, 2, 3),
bb AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, replicate ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below FROM bc),
br AS (SELECT model, replicate, SUM(CASE WHEN p >= 5e-1 THEN pos ELSE neg END) / SUM(pos + neg) AS accuracy, 2e0 * SUM(CASE WHEN p >= 5e-1 THEN pos ELSE 0 END) / (SUM(CASE WHEN p >= 5e-1 THEN pos + neg ELSE 0 END) + SUM(pos)) AS f1,
 SUM(pos * (1e0 - p) * (1e0 - p) + neg * p * p) / SUM(pos + neg) AS brier, SUM(pos * (below + neg / 2e0)) / (SUM(pos) * SUM(neg)) AS auc FROM bb GROUP BY 1, 2)
"""
REPLICATES = 1000
_BOOT = _CELLS.replace("{r}", str(REPLICATES))


def _replicates(spark, sf):
    return B.bootstrap(fx.predictions_long(spark, sf), ["model"], REPLICATES)


@query("m10_bootstrap_replicates", with_views(_BOOT + "SELECT model, CAST(replicate AS INT) AS replicate, ROUND(accuracy, 6) AS accuracy, ROUND(f1, 6) AS f1, ROUND(brier, 6) AS brier, ROUND(auc, 6) AS auc FROM br", "fx_long"))
def m10(spark, sf):
    return _replicates(spark, sf).select("model", "replicate", *[r6(c) for c in ("accuracy", "f1", "brier", "auc")])


_INTERVALS = " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, ROUND(AVG({m}), 6) AS mean, ROUND(STDDEV_POP({m}), 6) AS std, COUNT(*) AS replicates, ROUND(quantile_cont({m}, 25e-3), 6) AS ci_lower, ROUND(quantile_cont({m}, 975e-3), 6) AS ci_upper FROM br GROUP BY model"
    for m in ("auc", "f1", "accuracy")
)


@query("m10_bootstrap_interval", with_views(_BOOT + _INTERVALS, "fx_long"))
def m10i(spark, sf):
    """Intervals of three metrics from the same replicates."""
    reps = M.to_long(_replicates(spark, sf), ["model"], ["auc", "f1", "accuracy"])
    d = M.bootstrap_interval(reps, ["model", "metric"], "value")
    return d.select("model", "metric", r6("mean"), r6("std"), "replicates", r6("ci_lower"), r6("ci_upper"))


@query("m10_bootstrap_rows", with_views(_ROWS + "SELECT model, replicate, ROUND(accuracy, 6) AS accuracy, ROUND(brier, 6) AS brier, ROUND(auc, 6) AS auc FROM br", "fx_long"))
def m10r(spark, sf):
    d = M.bootstrap_metrics(fx.predictions_long(spark, sf), ["model"], "event_id", 20)
    return d.select("model", "replicate", r6("accuracy"), r6("brier"), r6("auc"))


@query("m11_compare_models", _q("SELECT model, split, ROUND(auc, 6) AS auc, CAST(ROW_NUMBER() OVER (PARTITION BY split ORDER BY auc DESC, model) AS INT) AS rank FROM rep"))
def m11(spark, sf):
    return M.rank_models(M.report(preds(spark, sf), KEYS), "auc", ["split"]).select(*KEYS, r6("auc"), "rank")


@query("k4_ranked_models", _q("SELECT model, split, ROUND(composite, 6) AS composite, CAST(ROW_NUMBER() OVER (PARTITION BY split ORDER BY composite DESC, model) AS INT) AS rank FROM rep"))
def k4(spark, sf):
    return M.rank_models(M.report(preds(spark, sf), KEYS), "composite", ["split"]).select(*KEYS, r6("composite"), "rank")


@query(
    "m13_t_against_baseline",
    with_views(
        _BOOT + " UNION ALL ".join(
            f"SELECT model, '{m}' AS metric, ROUND(AVG({m}) - 6e-1, 6) AS mean_difference, ROUND((AVG({m}) - 6e-1) / (STDDEV_SAMP({m}) / SQRT(COUNT(*))), 4) AS t, ROUND((AVG({m}) - 6e-1) / 6e-1 * 1e2, 6) AS improvement_pct FROM br GROUP BY model"
            for m in ("f1", "accuracy")
        ),
        "fx_long",
    ),
)
def m13(spark, sf):
    """Both tested metrics against a baseline of 0.6; the deviation is the sample's."""
    reps = M.to_long(_replicates(spark, sf), ["model"], ["f1", "accuracy"])
    d = M.t_against(reps, ["model", "metric"], "value", 0.6)
    return d.select("model", "metric", r6("mean_difference"), F.round("t", 4).alias("t"), r6("improvement_pct"))


_CONF = """, q AS (SELECT quantile_cont(ABS(p - y_true), 95e-2) AS q FROM fx_long WHERE ts < TIMESTAMP '2024-01-16'),
c AS (SELECT model, event_id, p, ABS(p - 5e-1) AS a, {m} * (1e0 - ABS(p - 5e-1)) AS m FROM fx_long, q)
SELECT model, event_id, CASE WHEN 5e-1 + a >= 7e-1 THEN 'high' WHEN 5e-1 + a >= 55e-2 THEN 'medium' ELSE 'low' END AS confidence_level,
 ROUND(GREATEST(0e0, LEAST(1e0, p - m)), 6) AS lower_bound, ROUND(GREATEST(0e0, LEAST(1e0, p + m)), 6) AS upper_bound FROM c"""


@query("m14_confidence_bounds", with_views(_CONF.format(m="q"), "fx_long"))
def m14(spark, sf):
    p = preds(spark, sf)
    d = M.confidence(p, M.residual_quantile(p.filter("split = 'train'")))
    return d.select("model", "event_id", "confidence_level", r6("lower_bound"), r6("upper_bound"))


@query("m14_confidence_heuristic", with_views(_CONF.format(m="15e-2"), "fx_long"))
def m14h(spark, sf):
    return M.confidence(preds(spark, sf)).select("model", "event_id", "confidence_level", r6("lower_bound"), r6("upper_bound"))


@query(
    "m14_penalised_confidence",
    with_views(
        """, c AS (SELECT model, event_id, p, GREATEST(p, 1e0 - p) * (1e0 - (user_id % 6) / 1e1) AS c, 5e-2 + 1e-1 * (1e0 - ABS(p - 5e-1) * 2e0) AS m FROM fx_long)
SELECT model, event_id, ROUND(c, 6) AS confidence, CASE WHEN c >= 7e-1 THEN 'high' WHEN c >= 55e-2 THEN 'medium' ELSE 'low' END AS confidence_level, ROUND(GREATEST(p - m, 0e0), 6) AS lower_bound, ROUND(LEAST(p + m, 1e0), 6) AS upper_bound FROM c""",
        "fx_long",
    ),
)
def m14p(spark, sf):
    # penalties of 0 to 0.5, as edge cases give
    d = M.penalised_confidence(preds(spark, sf).withColumn("penalty", (F.col("user_id") % 6) / F.lit(10.0)), "penalty")
    return d.select("model", "event_id", r6("confidence"), "confidence_level", r6("lower_bound"), r6("upper_bound"))


@query(
    "m15_generalization_gap",
    _q(""", g AS (SELECT t.model, t.auc - v.auc AS a, t.f1 - v.f1 AS f, t.accuracy - v.accuracy AS c FROM rep t JOIN rep v ON t.model = v.model AND t.split = 'train' AND v.split = 'val')
SELECT model, ROUND(a, 6) AS auc_gap, ROUND(f, 6) AS f1_gap, ROUND(c, 6) AS accuracy_gap, ROUND(a * 4e-1 + f * 3e-1 + c * 3e-1, 6) AS gap_score,
 CASE WHEN a * 4e-1 + f * 3e-1 + c * 3e-1 > 5e-2 THEN 'high_overfitting' WHEN a * 4e-1 + f * 3e-1 + c * 3e-1 > 2e-2 THEN 'moderate_overfitting' WHEN a * 4e-1 + f * 3e-1 + c * 3e-1 > -2e-2 THEN 'good' ELSE 'underfitting' END AS label FROM g"""),
)
def m15(spark, sf):
    d = M.generalization_gap(M.report(preds(spark, sf), KEYS), ["model"])
    return d.select("model", r6("auc_gap"), r6("f1_gap"), r6("accuracy_gap"), r6("gap_score"), "label")


NAMES = ["auc", "f1", "accuracy", "mcc", "kappa", "log_loss", "brier", "ece"]
_LONGREP = ", ml AS (" + " UNION ALL ".join(f"SELECT model, split, '{n}' AS metric, {c} AS value FROM rep" for n, c in zip(NAMES, ["auc", "f1", "accuracy", "mcc", "kappa", "ll", "br", "ece"])) + ")\n"


def _metric_table(spark, sf):
    return M.to_long(M.report(preds(spark, sf), KEYS), KEYS, NAMES)


@query(
    "m16_against_baseline",
    _q(_LONGREP + """SELECT metric, ROUND(cur, 6) AS current, ROUND(base, 6) AS baseline, ROUND(imp, 6) AS improvement, ROUND(imp / ABS(base) * 1e2, 4) AS improvement_pct, CAST(imp > 0 AS INT) AS is_better
FROM (SELECT a.metric, a.value AS cur, b.value AS base, CASE WHEN a.metric IN ('log_loss', 'brier', 'ece') THEN b.value - a.value ELSE a.value - b.value END AS imp FROM ml a JOIN ml b ON a.metric = b.metric AND a.model = 'b' AND b.model = 'a' AND a.split = 'val' AND b.split = 'val')"""),
)
def m16(spark, sf):
    t = _metric_table(spark, sf).filter("split = 'val'")
    d = M.against_baseline(t.filter("model = 'b'"), t.filter("model = 'a'"))
    return d.select("metric", r6("current"), r6("baseline"), r6("improvement"), F.round("improvement_pct", 4).alias("improvement_pct"), F.col("is_better").cast("int").alias("is_better"))


@query(
    "m17_compare_versions",
    _q(_LONGREP + """SELECT a.metric, ROUND(a.value, 6) AS first, ROUND(b.value, 6) AS second, ROUND(b.value - a.value, 6) AS difference, ROUND((b.value - a.value) / a.value * 1e2, 4) AS pct_change
FROM ml a JOIN ml b ON a.metric = b.metric AND a.model = 'a' AND b.model = 'b' AND a.split = 'val' AND b.split = 'val'"""),
)
def m17(spark, sf):
    t = _metric_table(spark, sf).filter("split = 'val'").withColumnRenamed("model", "version")
    d = M.compare_versions(t, "a", "b")
    return d.select("metric", r6("first"), r6("second"), r6("difference"), F.round("pct_change", 4).alias("pct_change"))


@query(
    "m17_promotion",
    _q("""SELECT ROUND(b.auc - a.auc, 6) AS auc_difference, ROUND(b.f1 - a.f1, 6) AS f1_difference, CASE WHEN b.auc > a.auc AND b.f1 > a.f1 THEN 'second' WHEN b.auc <= a.auc AND b.f1 <= a.f1 THEN 'first' ELSE 'unclear' END AS recommended,
 CAST(b.auc - a.auc >= 5e-3 AND b.f1 - a.f1 >= 5e-3 AS INT) AS promote FROM rep a JOIN rep b ON a.model = 'a' AND b.model = 'b' AND a.split = 'val' AND b.split = 'val'"""),
)
def m17p(spark, sf):
    t = _metric_table(spark, sf).filter("split = 'val'").withColumnRenamed("model", "version")
    d = M.promotion(M.compare_versions(t, "a", "b"))
    return d.select(r6("auc_difference"), r6("f1_difference"), "recommended", F.col("promote").cast("int").alias("promote"))


@query("k6_best_run", _q("SELECT model, split, ROUND((auc + f1 + (mcc + 1e0) / 2e0) / 3e0, 6) AS score FROM rep ORDER BY (auc + f1 + (mcc + 1e0) / 2e0) / 3e0 DESC LIMIT 1"))
def k6(spark, sf):
    return M.best_run(M.report(preds(spark, sf), KEYS), KEYS).select("model", "split", r6("score"))


@query(
    "m18_evaluation_report",
    _q("""SELECT model, split, CAST(n AS BIGINT) AS rows, ROUND(accuracy, 6) AS accuracy, ROUND(f1, 6) AS f1, ROUND(mcc, 6) AS mcc, ROUND(kappa, 6) AS kappa, ROUND(auc, 6) AS auc, ROUND(ll, 6) AS log_loss, ROUND(br, 6) AS brier,
 ROUND(ece, 6) AS ece, ROUND(mce, 6) AS mce, ROUND(composite, 6) AS composite, CAST(ROW_NUMBER() OVER (PARTITION BY split ORDER BY composite DESC, model) AS INT) AS rank FROM rep"""),
)
def m18(spark, sf):
    d = M.rank_models(M.report(preds(spark, sf), KEYS), "composite", ["split"])
    return d.select(*KEYS, "rows", *[r6(c) for c in ("accuracy", "f1", "mcc", "kappa", "auc", "log_loss", "brier", "ece", "mce", "composite")], "rank")


@query("d21_upsets", _q("SELECT model, COUNT(*) AS rows, COUNT(*) FILTER (WHERE ABS(p - 5e-1) > 3e-1 AND yp <> y_true) AS upsets, ROUND(COUNT(*) FILTER (WHERE ABS(p - 5e-1) > 3e-1 AND yp <> y_true) * 1e2 / COUNT(*), 6) AS upset_pct FROM pr GROUP BY model"))
def d21(spark, sf):
    return M.upset_analysis(preds(spark, sf), ["model"]).select("model", "rows", "upsets", r6("upset_pct"))


@query(
    "j13_two_perspectives",
    with_views(
        "SELECT gameid, ROUND((MAX(CASE WHEN side = 'Blue' THEN p END) + 1e0 - MAX(CASE WHEN side = 'Red' THEN p END)) / 2e0, 6) AS blue_win_prob, ROUND(1e0 - (MAX(CASE WHEN side = 'Blue' THEN p END) + 1e0 - MAX(CASE WHEN side = 'Red' THEN p END)) / 2e0, 6) AS red_win_prob FROM (SELECT gameid, side, (row_id * 37 % 101) / 101e0 AS p FROM fx_matches) GROUP BY gameid",
        "fx_matches",
    ),
)
def j13(spark, sf):
    m = fx.matches(spark, sf).withColumn("p", (F.col("row_id") * 37 % 101) / F.lit(101.0))
    return M.combine_perspectives(m, "gameid", "side", "p").select("gameid", r6("blue_win_prob"), r6("red_win_prob"))


@query("p5_soft_vote", _q(", w AS (SELECT model, f1 AS weight FROM rep WHERE split = 'train') SELECT event_id, ROUND(SUM(p * weight) / SUM(weight), 6) AS p FROM pr JOIN w USING (model) GROUP BY event_id"))
def p5(spark, sf):
    p = preds(spark, sf)
    w = M.confusion_metrics(p.filter("split = 'train'"), ["model"]).select("model", F.col("f1").alias("weight"))
    return M.soft_vote(p, w, "event_id").select("event_id", r6("p"))


@query("p7_prediction_correlation", with_views("SELECT 'a' AS first, 'b' AS second, ROUND(CORR(p_a, p_b), 6) AS corr FROM fx_preds", "fx_preds"))
def p7(spark, sf):
    return M.prediction_correlation(preds(spark, sf), "event_id").select("first", "second", r6("corr"))


_VOTES = """, vf AS (SELECT model, p, y_true, CAST(CAST('0x' || substr(md5('te-' || CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT) % 5 AS INT) AS fold FROM fx_long),
vs AS (SELECT model, fold, p, CAST(SUM(y_true) AS DOUBLE) AS pos, CAST(SUM(1 - y_true) AS DOUBLE) AS neg FROM (SELECT model, fold, p, y_true FROM vf UNION ALL SELECT model, -1, p, y_true FROM vf) GROUP BY 1, 2, 3),
vb AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below FROM vs),
va AS (SELECT model, fold, SUM(pos * (below + neg / 2e0)) / (SUM(pos) * SUM(neg)) AS auc FROM vb GROUP BY 1, 2),
v1 AS (SELECT model, 2e0 * SUM(CASE WHEN p >= 5e-1 THEN y_true ELSE 0 END) / (SUM(CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END) + SUM(y_true)) AS f1 FROM fx_long GROUP BY model),
vw AS (SELECT model, f1, (SELECT auc FROM va x WHERE x.model = v1.model AND fold = -1) AS auc, cv_mean, cv_std FROM v1 JOIN (SELECT model, AVG(auc) AS cv_mean, STDDEV_POP(auc) AS cv_std FROM va WHERE fold >= 0 GROUP BY model) USING (model)),
wt AS (SELECT 'f1' AS kind, model, f1 / (1e0 + cv_std) AS weight FROM vw UNION ALL SELECT 'balanced', model, 5e-1 * auc + 3e-1 * cv_mean + 2e-1 * (1e0 - cv_std) FROM vw UNION ALL SELECT 'performance', model, 4e-1 * auc + 4e-1 * f1 + 2e-1 * cv_mean FROM vw)
"""


def _weights(spark, sf):
    p = fx.predictions_long(spark, sf)
    scores = M.vote_scores(p, fold_of("event_id", 5))
    return p, [(kind, training.vote_weights(scores, kind)) for kind in ("f1", "balanced", "performance")]


@query("p5_vote_weights", with_views(_VOTES + "SELECT kind, model, ROUND(weight, 6) AS weight FROM wt", "fx_long"))
def p5w(spark, sf):
    """Three ways to weigh the models, from whole and out-of-fold results."""
    parts = [w.select(F.lit(kind).alias("kind"), "model", r6("weight")) for kind, w in _weights(spark, sf)[1]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p5_weighted_votes", with_views(_VOTES + ", sv AS (SELECT kind, event_id, MAX(y_true) AS y, SUM(p * weight) / SUM(weight) AS p FROM fx_long JOIN wt USING (model) GROUP BY 1, 2) SELECT kind, COUNT(*) AS rows, ROUND(AVG((p - y) * (p - y)), 6) AS brier, ROUND(AVG(CASE WHEN CAST(p >= 5e-1 AS INT) = y THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM sv GROUP BY kind", "fx_long"))
def p5v(spark, sf):
    """What each way of weighing gives."""
    p, kinds = _weights(spark, sf)
    truth = p.groupBy("event_id").agg(F.max("y_true").alias("y_true"))
    parts = [M.soft_vote(p, w, "event_id").withColumn("kind", F.lit(kind)) for kind, w in kinds]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(truth, "event_id")
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y_true")).cast("double")
    return d.groupBy("kind").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("p") - F.col("y_true")) * (F.col("p") - F.col("y_true"))), 6).alias("brier"), F.round(F.avg(hit), 6).alias("accuracy"))


@query(
    "p5_weight_search",
    with_views(
        """, g AS (SELECT i / 1e1 AS w, CAST(i AS VARCHAR) || '-' || CAST(10 - i AS VARCHAR) AS weights FROM (SELECT UNNEST(range(0, 11)) AS i)), m AS (SELECT weights, y_true AS y, p_a * w + p_b * (1e0 - w) AS p FROM fx_preds, g)
SELECT weights, ROUND(AVG((p - y) * (p - y)), 6) AS brier, ROUND(AVG(-CASE WHEN y = 1 THEN LN(p) ELSE LN(1e0 - p) END), 6) AS log_loss FROM m GROUP BY weights""",
        "fx_preds",
    ),
)
def p5s(spark, sf):
    """Every mix of the two models in tenths, in one aggregate of the rows."""
    d = M.search_weights(fx.predictions_long(spark, sf), "event_id", ["a", "b"])
    return d.select("weights", r6("brier"), r6("log_loss"))
