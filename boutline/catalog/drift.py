"""Queries over drift of features and performance."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.catalog.evaluation import _LONGREP, _P, _metric_table, preds
from boutline.evaluation import drift
from boutline.fixtures import table, with_views

CUT = "2024-01-16"


def _features(spark, sf):
    p = fx.predictions(spark, sf).join(table(spark, sf, "events").select("event_id", "value"), "event_id")
    p = p.withColumn("is_current", F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))
    return drift.features_long(p, ["p_a", "p_b", "value"], ["is_current"])


_LONG = f""", fl AS (SELECT ts >= TIMESTAMP '{CUT}' AS cur, 'p_a' AS feature, p_a AS v FROM fx_preds UNION ALL SELECT ts >= TIMESTAMP '{CUT}', 'p_b', p_b FROM fx_preds UNION ALL SELECT ts >= TIMESTAMP '{CUT}', 'value', value FROM events),
rg AS (SELECT feature, MIN(v) FILTER (WHERE NOT cur) AS lo, MAX(v) FILTER (WHERE NOT cur) AS hi, COUNT(*) FILTER (WHERE NOT cur) AS nr, COUNT(*) FILTER (WHERE cur) AS nc FROM fl GROUP BY feature),
bb AS (SELECT fl.feature, cur, """ + " + ".join(f"CAST(v >= lo + (hi - lo) / 1e1 * {i}e0 AS INT)" for i in range(1, 10)) + """ AS bin FROM fl JOIN rg ON fl.feature = rg.feature WHERE v >= lo AND v <= hi),
gc AS (SELECT rg.feature, i, nr, nc, COUNT(*) FILTER (WHERE cur IS NOT NULL AND NOT cur) AS r, COUNT(*) FILTER (WHERE cur) AS c FROM rg CROSS JOIN (SELECT UNNEST(range(10)) AS i) LEFT JOIN bb ON bb.feature = rg.feature AND bb.bin = i GROUP BY 1, 2, 3, 4),
ps AS (SELECT feature, SUM(((c + 1e0) / (nc + 10) - (r + 1e0) / (nr + 10)) * LN(((c + 1e0) / (nc + 10)) / ((r + 1e0) / (nr + 10)))) AS psi FROM gc GROUP BY feature),
vc AS (SELECT feature, v, CAST(COUNT(*) FILTER (WHERE NOT cur) AS DOUBLE) AS r, CAST(COUNT(*) FILTER (WHERE cur) AS DOUBLE) AS c FROM fl GROUP BY 1, 2),
kk AS (SELECT feature, ABS(SUM(r) OVER (PARTITION BY feature ORDER BY v) / SUM(r) OVER (PARTITION BY feature) - SUM(c) OVER (PARTITION BY feature ORDER BY v) / SUM(c) OVER (PARTITION BY feature)) AS g FROM vc),
ks AS (SELECT feature, MAX(g) AS ks FROM kk GROUP BY feature),
fd AS (SELECT f.feature, psi, ks, rm, cm, rs, cs, psi > 1e-1 OR ks > 1e-1 AS drifted FROM (SELECT feature, AVG(v) FILTER (WHERE NOT cur) AS rm, AVG(v) FILTER (WHERE cur) AS cm, STDDEV_SAMP(v) FILTER (WHERE NOT cur) AS rs, STDDEV_SAMP(v) FILTER (WHERE cur) AS cs FROM fl GROUP BY 1) f JOIN ps USING (feature) JOIN ks USING (feature))
"""


@query("r2_psi", with_views(_LONG + "SELECT feature, ROUND(psi, 6) AS psi, nr AS reference_rows, nc AS current_rows FROM ps JOIN rg USING (feature)", "fx_preds"))
def r2(spark, sf):
    return drift.psi(_features(spark, sf), ["feature"]).select("feature", r6("psi"), "reference_rows", "current_rows")


@query("r3_ks", with_views(_LONG + "SELECT feature, ROUND(ks, 6) AS ks FROM ks", "fx_preds"))
def r3(spark, sf):
    return drift.ks_statistic(_features(spark, sf), ["feature"]).select("feature", r6("ks"))


@query(
    "r4_feature_drift",
    with_views(_LONG + "SELECT feature, ROUND(psi, 6) AS psi, ROUND(ks, 6) AS ks, ROUND(rm, 6) AS reference_mean, ROUND(cm, 6) AS current_mean, ROUND(rs, 6) AS reference_std, ROUND(cs, 6) AS current_std, CAST(drifted AS INT) AS drifted FROM fd", "fx_preds"),
)
def r4(spark, sf):
    d = drift.feature_drift(_features(spark, sf))
    return d.select("feature", *[r6(c) for c in ("psi", "ks", "reference_mean", "current_mean", "reference_std", "current_std")], F.col("drifted").cast("int").alias("drifted"))


@query(
    "r4_feature_drift_summary",
    with_views(
        _LONG + """, t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE drifted) AS k FROM fd) SELECT n AS features, k AS drifted, ROUND(k / CAST(n AS DOUBLE), 6) AS drift_share,
 CASE WHEN k / CAST(n AS DOUBLE) > 3e-1 THEN 'critical' WHEN k / CAST(n AS DOUBLE) > 15e-2 THEN 'high' WHEN k / CAST(n AS DOUBLE) > 5e-2 THEN 'medium' ELSE 'low' END AS severity FROM t""",
        "fx_preds",
    ),
)
def r4s(spark, sf):
    d = drift.feature_drift_summary(drift.feature_drift(_features(spark, sf)))
    return d.select("features", "drifted", r6("drift_share"), "severity")


_R1 = """, x AS (SELECT a.metric, b.value AS base, a.value AS cur, CASE a.metric WHEN 'log_loss' THEN a.value - b.value ELSE b.value - a.value END AS dr, CASE a.metric WHEN 'auc' THEN 2e-2 WHEN 'f1' THEN 3e-2 WHEN 'accuracy' THEN 3e-2 ELSE 5e-2 END AS th
 FROM ml a JOIN ml b ON a.metric = b.metric AND a.model = 'b' AND b.model = 'a' AND a.split = 'val' AND b.split = 'train' WHERE a.metric IN ('auc', 'f1', 'accuracy', 'log_loss')),
r1 AS (SELECT *, CASE WHEN metric IN ('auc', 'f1') AND dr >= 2e0 * th THEN 3 WHEN dr >= th THEN 2 WHEN metric IN ('auc', 'f1') AND dr >= 5e-1 * th THEN 1 ELSE 0 END AS sev FROM x)
"""


def _findings(spark, sf):
    t = _metric_table(spark, sf)
    return drift.performance_drift(t.filter("model = 'b' AND split = 'val'"), t.filter("model = 'a' AND split = 'train'"))


@query("r1_performance_drift", with_views(_P + _LONGREP + _R1 + "SELECT metric, ROUND(base, 6) AS baseline, ROUND(cur, 6) AS current, ROUND(dr, 6) AS drop, th AS threshold, sev AS severity_rank FROM r1", "fx_long"))
def r1(spark, sf):
    return _findings(spark, sf).select("metric", r6("baseline"), r6("current"), r6("drop"), "threshold", "severity_rank")


@query(
    "r8_drift_summary",
    with_views(
        _P + _LONGREP + _R1 + """, t AS (SELECT COUNT(*) AS n, MAX(sev) AS s FROM r1) SELECT n AS findings, CAST(s >= 2 AS INT) AS is_drifting, (['low', 'medium', 'high', 'critical'])[s + 1] AS severity,
 (['none', 'monitor', 'soon', 'immediate'])[s + 1] AS urgency, CAST(s >= 2 AS INT) AS should_retrain FROM t""",
        "fx_long",
    ),
)
def r8(spark, sf):
    d = drift.drift_summary(_findings(spark, sf))
    return d.select("findings", F.col("is_drifting").cast("int").alias("is_drifting"), "severity", "urgency", F.col("should_retrain").cast("int").alias("should_retrain"))


def _daily(spark, sf, unit="day"):
    p = preds(spark, sf)
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("y_true")).cast("int")
    return p.groupBy("model", F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("t")).agg((F.sum(ok) / F.count("*")).alias("accuracy"))


_DAY = ", dy AS (SELECT model, date_trunc('day', ts) AS t, AVG(CASE WHEN CAST(p >= 5e-1 AS INT) = y_true THEN 1e0 ELSE 0e0 END) AS a FROM fx_long GROUP BY 1, 2)"


@query(
    "r5_decay_rate",
    with_views(
        _DAY + """, z AS (SELECT dy.model, a, (epoch(t) - epoch(t0)) / 864e2 AS d, la, (epoch(t1) - epoch(t0)) / 864e2 AS sp FROM dy JOIN (SELECT model, MIN(t) AS t0, MAX(t) AS t1, ARG_MAX(a, t) AS la FROM dy GROUP BY 1) f ON dy.model = f.model),
g AS (SELECT model, COUNT(*) AS n, regr_slope(a, d) AS s, regr_intercept(a, d) AS i, regr_r2(a, d) AS r2, MAX(la) AS la, MAX(sp) AS sp FROM z GROUP BY 1)
SELECT model, n, ROUND(s, 6) AS slope, ROUND(s * 30, 6) AS slope_per_month, ROUND(i, 6) AS intercept, ROUND(r2, 6) AS r2, ROUND(SIGN(s) * SQRT(r2 * (n - 2) / (1e0 - r2)), 6) AS t,
 ROUND(CASE WHEN s < 0 AND la > 75e-2 AND (75e-2 - i - s * sp) / s > 0 THEN (75e-2 - i - s * sp) / s / 30 END, 4) AS months_to_threshold FROM g""",
        "fx_long",
    ),
)
def r5(spark, sf):
    d = drift.decay_rate(_daily(spark, sf), ["model"], "t", "accuracy")
    return d.select("model", "n", r6("slope"), r6("slope_per_month"), r6("intercept"), r6("r2"), r6("t"), F.round("months_to_threshold", 4).alias("months_to_threshold"))


def _correct(spark, sf):
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("y_true")).cast("double")
    # from the middle of the period on, model b stands in for model a: a known change
    return preds(spark, sf).select("model", "event_id", "ts", ok.alias("ok"))



def _levels():
    return [F.to_date("ts"), F.hour("ts")]


_CUT6 = """, sq AS (SELECT event_id, ts, CASE WHEN CAST(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN p_a ELSE p_b END >= 5e-1 AS INT) = y_true THEN 1e0 ELSE 0e0 END AS v FROM fx_preds),
pf AS (SELECT ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS n0, SUM(v) OVER (ORDER BY ts, event_id) - v AS s0, COUNT(*) OVER () AS n, SUM(v) OVER () AS s, VAR_POP(v) OVER () + 1e-10 AS var FROM sq),
cd AS (SELECT n0, ABS(s0 / n0 - (s - s0) / (n - n0)) AS diff, SQRT(2e0 / (n0 * CAST(n - n0 AS DOUBLE) / n) * var * LN(1e3)) + 2e0 / (3e0 * (n0 * CAST(n - n0 AS DOUBLE) / n)) * LN(1e3) AS eps FROM pf WHERE n0 >= 5 AND n0 < n - 5)
SELECT n0 AS cut, ROUND(diff, 6) AS mean_difference, ROUND(eps, 6) AS epsilon FROM cd WHERE diff > eps ORDER BY diff DESC, n0 LIMIT 1"""


@query("r6_adaptive_cut", with_views(_CUT6, "fx_preds"))
def r6_cut(spark, sf):
    p = fx.predictions(spark, sf)
    pr = F.when(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"), F.col("p_a")).otherwise(F.col("p_b"))
    d = p.select("event_id", "ts", ((pr >= 0.5).cast("int") == F.col("y_true")).cast("double").alias("v"))
    out = drift.adaptive_cut(d, [], _levels(), ["ts", "event_id"], "v")
    return out.select(F.col("cut").cast("long").alias("cut"), r6("mean_difference"), r6("epsilon"))


def series(spark, sf):
    """Many series in event order: each model's hits for groups of four users, of which
    every third turns round in the middle; and hourly accuracy, which is longer."""
    p = fx.predictions_long(spark, sf)
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("y_true")).cast("double")
    late, group = F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"), F.floor(F.col("user_id") / 4)
    hits = p.select("model", F.concat(F.lit("u"), group.cast("string")).alias("series"), "ts", "event_id", F.when(late & (group % 3 == 0), 1 - ok).otherwise(ok).alias("v"))
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    hourly = p.groupBy("model", hour.alias("ts")).agg(F.sum(F.when(late, 1 - ok).otherwise(ok)).alias("s"), F.count("*").alias("n"))
    return hits.unionByName(hourly.select("model", F.lit("hourly").alias("series"), "ts", F.lit(0).cast(dict(hits.dtypes)["event_id"]).alias("event_id"), (F.col("s") / F.col("n")).alias("v")))


# Borders that age leaves, and cuts one after the other: each step finds, in every series,
# the first position with a border beyond the bound and the best border there.
SEQUENCE = """, sk AS (SELECT model, user_id // 4 AS g, ts, event_id, CASE WHEN CAST(p >= 5e-1 AS INT) = y_true THEN 1e0 ELSE 0e0 END AS ok FROM fx_long),
sa AS (SELECT model, 'u' || CAST(g AS VARCHAR) AS series, ts, event_id, CASE WHEN ts >= TIMESTAMP '2024-01-16' AND g % 3 = 0 THEN 1e0 - ok ELSE ok END AS v FROM sk
  UNION ALL SELECT model, 'hourly', date_trunc('hour', ts), 0, SUM(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1e0 - ok ELSE ok END) / COUNT(*) FROM sk GROUP BY 1, 2, 3),
sp AS (SELECT model, series, v, ROW_NUMBER() OVER w - 1 AS i, COUNT(*) OVER (PARTITION BY model, series) AS n, SUM(v) OVER w - v AS s, SUM(v * v) OVER w - v * v AS q FROM sa WINDOW w AS (PARTITION BY model, series ORDER BY ts, event_id)),
bo AS MATERIALIZED (SELECT a.model, a.series, a.i AS t, a.s + a.v AS st, a.q + a.v * a.v AS qt, b.i AS b, b.s AS sb FROM sp a JOIN sp b ON a.model = b.model AND a.series = b.series AND b.i < a.i - 4
  WHERE a.n >= 60 AND a.i >= 30 AND b.i % CAST(power(2, floor(log2(greatest(1e0, (a.i - b.i) / 32e0)))) AS BIGINT) = 0),
rc AS (SELECT DISTINCT model, series, CAST(0 AS BIGINT) AS start, CAST(30 AS BIGINT) AS lo, CAST(-1 AS BIGINT) AS position, CAST(0 AS BIGINT) AS window_size FROM sp
 UNION ALL SELECT model, series, x.b + 1, x.t + 1, x.b, x.t + 1 - start FROM (
  SELECT model, series, start, MIN(struct_pack(t := t, d := -gap, b := b)) AS x FROM (
   SELECT rc.model, rc.series, rc.start, c.t, c.b, ABS((c.sb - z.s) / (c.b - rc.start) - (c.st - c.sb) / (c.t + 1 - c.b)) AS gap,
    (c.b - rc.start) * CAST(c.t + 1 - c.b AS DOUBLE) / (c.t + 1 - rc.start) AS m,
    greatest((c.qt - z.q) / (c.t + 1 - rc.start) - ((c.st - z.s) / (c.t + 1 - rc.start)) * ((c.st - z.s) / (c.t + 1 - rc.start)), 0e0) + 1e-10 AS var
   FROM rc JOIN bo c ON c.model = rc.model AND c.series = rc.series AND c.t >= rc.lo AND c.b - rc.start >= 5 JOIN sp z ON z.model = rc.model AND z.series = rc.series AND z.i = rc.start)
  WHERE gap > sqrt(2e0 / m * var * LN(1e3)) + 2e0 / (3e0 * m) * LN(1e3) GROUP BY model, series, start))
"""


def recursive(sql):
    return with_views(SEQUENCE + sql, "fx_long").replace("WITH ", "WITH RECURSIVE ", 1)


@query("r6_adaptive_sequence", recursive("SELECT model, series, position, window_size FROM rc WHERE position >= 0"))
def r6_seq(spark, sf):
    return drift.adaptive_sequence(series(spark, sf), ["model", "series"], ["ts", "event_id"], "v")


@query(
    "r7_sliding_drift",
    with_views(
        """, o AS (SELECT model, ROW_NUMBER() OVER (PARTITION BY model ORDER BY ts, event_id) - 1 AS k, CASE WHEN CAST(p >= 5e-1 AS INT) = y_true THEN 1e0 ELSE 0e0 END AS v FROM fx_long),
f AS (SELECT model, k, AVG(v) OVER w AS m, STDDEV_POP(v) OVER w AS s, COUNT(*) OVER w AS c FROM o WINDOW w AS (PARTITION BY model ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
g AS (SELECT model, CAST(k // 10 AS BIGINT) AS wi, m, s FROM f WHERE k % 10 = 0 AND c = 50),
h AS (SELECT a.model, a.wi, b.m AS mb, a.m AS ma, SQRT((a.s * a.s + b.s * b.s) / 2e0) AS ps FROM g a JOIN g b ON a.model = b.model AND a.wi = b.wi + 1)
SELECT model, wi AS window_index, ROUND(mb, 6) AS mean_before, ROUND(ma, 6) AS mean_after, ROUND(CASE WHEN ps > 0 THEN ABS(ma - mb) / ps ELSE 0e0 END, 5) AS effect_size FROM h""",
        "fx_long",
    ),
)
def r7(spark, sf):
    d = drift.sliding_drift(_correct(spark, sf), ["model"], _levels(), ["ts", "event_id"], "ok")
    return d.select("model", "window_index", r6("mean_before"), r6("mean_after"), F.round("effect_size", 5).alias("effect_size"))


@query(
    "r9_retrain_trigger",
    with_views(
        """, m AS (SELECT date_trunc('month', o_orderdate) AS mo, MAX(o_orderdate) AS ts, COUNT(*) AS rows FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
l AS (SELECT MAX(ts) AS t, ARG_MAX(rows, ts) AS r FROM m), n AS (SELECT MAX(o_orderdate) AS now, COUNT(*) AS rows FROM orders),
z AS (SELECT CASE WHEN epoch(now) - epoch(t) < 14400 THEN 'cooldown' WHEN FLOOR((epoch(now) - epoch(t)) / 864e2) >= 30 THEN 'forced' WHEN rows - r >= 500 THEN 'new_data' ELSE 'none' END AS reason FROM l, n)
SELECT reason, CAST(reason NOT IN ('cooldown', 'none') AS INT) AS should_retrain FROM z""",
        "fx_preds",
    ),
)
def r9(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    runs = o.filter("ts < TIMESTAMP '1999-01-01'").groupBy(F.date_trunc("month", "ts").alias("m")).agg(F.max("ts").alias("ts"), F.count("*").alias("rows"))
    d = drift.retrain_trigger(runs, o.agg(F.count("*")).scalar(), o.agg(F.max("ts")).scalar())
    return d.select("reason", F.col("should_retrain").cast("int").alias("should_retrain"))
