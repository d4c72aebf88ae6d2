"""Queries that train or apply models. Fits have no SQL counterpart; what is
computed from fitted numbers has."""

from functools import reduce

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.catalog.evaluation import preds
from boutline.catalog.features import ALL, TRAIN, _DRAFT_ROWS, vector_sql
from boutline.evaluation import metrics as M
from boutline.fixtures import with_views
from boutline.ml import lifecycle, newton, training
from boutline.ml.scoring import DraftScorer
from boutline.operators import encoding, features, form, lookups, splits
from boutline.operators.features import CANONICAL_48, FeatureModel
from boutline.roles import ROLE_PREFIX, ROLES
from boutline.session import cut_lineage

FORM = ["overall_winrate", "recent_winrate", "form_trend", "winrate_last_3", "performance_volatility", "current_streak"]


def _form(spark, sf):
    """Rows with history features, written once because several fits read them."""
    d = form.entity_form(fx.matches(spark, sf)).select("row_id", "match_date", "year", "result", *[F.col(c).cast("double").alias(c) for c in FORM])
    return cut_lineage(d)


def _scaled_sql(cols):
    return vector_sql(*ALL) + ", sc AS (SELECT row_id, " + ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS {c}" for c in cols) + " FROM vec)\n"


# Fixed coefficients, so that contributions can be stated in SQL as well.
COEF = {"team_avg_winrate": 0.8, "team_meta_strength": -0.4, "team_recent_winrate": 1.1, "team_lane_advantage": 0.3}


def _small(spark, sf):
    w = cut_lineage(fx.wide(spark, sf))
    m = FeatureModel.fit(w)
    return cut_lineage(m.lanes(m.past(m.meta(m.composition(w)), "rows")).select("row_id", *COEF))


@query(
    "p1_standard_scaling",
    with_views(_scaled_sql(list(COEF)) + "SELECT row_id, " + ", ".join(f"ROUND({c}, 4) AS {c}" for c in COEF) + " FROM sc", "fx_wide"),
)
def p1(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    d = _small(spark, sf)
    n = d.count()
    m = Pipeline(stages=training.scaled_vector(list(COEF))).fit(d)
    a = vector_to_array("features")
    grow = (n / (n - 1)) ** 0.5  # sample to population deviation
    return m.transform(d).select("row_id", *[F.round(a[i] * grow, 4).alias(c) for i, c in enumerate(COEF)])


_CON = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {c} * {v!r}e0 AS v FROM sc" for c, v in COEF.items())


@query(
    "p8_top_contributions",
    with_views(
        _scaled_sql(list(COEF)) + f", cn AS ({_CON}), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY ABS(v) DESC, feature) AS place FROM cn) SELECT row_id, ROUND(SUM(ABS(v)), 4) AS top_size FROM rk WHERE place <= 2 GROUP BY row_id",
        "fx_wide",
    ),
)
def p8(spark, sf):
    d = _small(spark, sf)
    top = training.linear_contributions(d, features.scale_fit(d, list(COEF)), COEF, "row_id", top=2)
    # a row's contributions follow one another; their sum of sizes does not depend on ties
    return top.groupBy("row_id").agg(F.round(F.sum(F.abs("contribution")), 4).alias("top_size"))


@query("p8_contributions", with_views(_scaled_sql(list(COEF)) + f", cn AS ({_CON}) SELECT row_id, feature, ROUND(v, 4) AS contribution FROM cn", "fx_wide"))
def p8a(spark, sf):
    """Every feature's contribution in every row."""
    d = _small(spark, sf)
    c = training.linear_contributions(d, features.scale_fit(d, list(COEF)), COEF, "row_id", top=len(COEF))
    return c.select("row_id", "feature", F.round("contribution", 4).alias("contribution"))


@query("p8_global_importance", with_views(_scaled_sql(list(COEF)) + f", cn AS ({_CON}) SELECT feature, ROUND(AVG(ABS(v)), 6) AS importance FROM cn GROUP BY feature", "fx_wide"))
def p8g(spark, sf):
    d = _small(spark, sf)
    return training.global_importance(d, features.scale_fit(d, list(COEF)), COEF).select("feature", r6("importance"))


@query("p3_other_learners")
def p3(spark, sf):
    d = cut_lineage(splits.temporal_split(_form(spark, sf)))
    fitted = training.fit_learners(d.filter("split = 'train'"), FORM, training.learners(len(FORM)))
    val = d.filter("split = 'val'")
    scored = [training.predict(m, val, []).withColumn("model", F.lit(name)) for name, m in fitted.items()]
    return M.rank_models(M.report(reduce(lambda a, b: a.unionByName(b), scored), ["model"]), "auc")


def _oof(spark, sf):
    d = cut_lineage(_form(spark, sf).withColumn("fold", encoding.fold_of("row_id", 3)))
    models = {"logistic": None, "forest": training.learners(len(FORM))["random_forest"]}
    return training.out_of_fold(d, FORM, "fold", 3, models, ["row_id"])


@query("p6_stacking")
def p6(spark, sf):
    oof = cut_lineage(_oof(spark, sf))
    model, wide = training.stack(oof, ["logistic", "forest"], "row_id")
    return M.report(training.predict(model, wide, [], "y_true").withColumn("model", F.lit("stack")), ["model"])


@query("p7_diverse_models")
def p7d(spark, sf):
    p = preds(spark, sf)
    names = training.diverse_models(M.prediction_correlation(p, "event_id"), M.auc(p, ["model"]))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "place int, model string")


def _scorer(spark, sf):
    train = cut_lineage(fx.wide(spark, sf).filter("year < 1998"))
    fm = FeatureModel.fit(train)
    names = list(CANONICAL_48)
    rows = newton.design(fm.vector(train, "rows", ["row_id", "result"]), names, {"train": (F.lit(True), F.lit(False))})
    fitted = newton.fit_many(rows, names, ["train"], [newton.Fit("ridge", "train")])  # the objective of fit_logistic
    return DraftScorer(fm, {**dict(zip(names, fitted.coefficients[0].tolist())), "intercept": float(fitted.intercepts[0])})


@query("p11_score_drafts")
def p11(spark, sf):
    return _scorer(spark, sf).score(fx.drafts(spark, sf))


@query("p9_pick_impact")
def p9(spark, sf):
    return _scorer(spark, sf).pick_impact(fx.drafts(spark, sf))


# Fixed coefficients: what follows from them can be stated in SQL.
LINEAR = {
    "intercept": -0.7, "team_avg_winrate": 0.9, "team_meta_strength": 0.6, "team_recent_winrate": 0.5, "team_lane_advantage": 1.2, "side_blue": 0.1,
    "high_priority_bans": 0.02, "top_champion_target_encoded": 0.8, "mid_champion_target_encoded": -0.3, "team_historical_advantage": 0.4,
}
_Z = " + ".join(f"{v!r}e0" if c == "intercept" else f"{v!r}e0 * {c}" for c, v in LINEAR.items())
_SCORED = "pz AS (SELECT row_id, side, team_overall_winrate, team_recent_winrate, 1e0 / (1e0 + exp(-(" + _Z + "))) AS p FROM vec)"


def _linear(spark, sf):
    return DraftScorer(FeatureModel.fit(cut_lineage(fx.wide(spark, sf).filter("year < 1998"))), LINEAR)


@query(
    "p11_linear_scores",
    with_views(
        vector_sql(TRAIN, _DRAFT_ROWS, "snapshot") + f""", {_SCORED}, g AS (SELECT row_id // 2 AS draft_id, (MAX(CASE WHEN side = 'Blue' THEN p END) + 1e0 - MAX(CASE WHEN side = 'Red' THEN p END)) / 2e0 AS p,
 MAX(CASE WHEN side = 'Blue' THEN team_overall_winrate END) AS bo, MAX(CASE WHEN side = 'Red' THEN team_recent_winrate END) AS rr FROM pz GROUP BY 1)
SELECT draft_id, ROUND(p, 6) AS blue_win_prob, ROUND(1e0 - p, 6) AS red_win_prob, CASE WHEN 5e-1 + ABS(p - 5e-1) >= 7e-1 THEN 'high' WHEN 5e-1 + ABS(p - 5e-1) >= 55e-2 THEN 'medium' ELSE 'low' END AS confidence_level,
 ROUND(greatest(0e0, least(1e0, p - 15e-2 * (1e0 - ABS(p - 5e-1)))), 6) AS lower_bound, ROUND(greatest(0e0, least(1e0, p + 15e-2 * (1e0 - ABS(p - 5e-1)))), 6) AS upper_bound, ROUND(bo, 6) AS blue_team_overall_winrate, ROUND(rr, 6) AS red_team_recent_winrate FROM g""",
        "fx_wide",
    ),
)
def p11l(spark, sf):
    """Every draft scored from both sides by a linear model."""
    d = _linear(spark, sf).score(fx.drafts(spark, sf))
    return d.select("draft_id", r6("blue_win_prob"), r6("red_win_prob"), "confidence_level", r6("lower_bound"), r6("upper_bound"), r6("blue_team_overall_winrate"), r6("red_team_recent_winrate"))


_OFF = ", ".join(f"CASE WHEN x = {i} THEN '__neutral__' ELSE {p}_champion END AS {p}_champion" for i, p in enumerate(ROLE_PREFIX, 1))
_ROLE_OF = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES, 1))


@query(
    "p9_linear_pick_impact",
    with_views(
        vector_sql(TRAIN, f"SELECT * REPLACE (row_id * 6 + x AS row_id, {_OFF}) FROM ({_DRAFT_ROWS}), (SELECT UNNEST(range(0, 6)) AS x)", "snapshot")
        + f", {_SCORED}, b AS (SELECT row_id // 6 AS r, p FROM pz WHERE row_id % 6 = 0) SELECT r // 2 AS draft_id, side, CASE row_id % 6 {_ROLE_OF} END AS role, ROUND((b.p - pz.p) * 1e2, 1) AS impact_pct FROM pz JOIN b ON pz.row_id // 6 = b.r WHERE row_id % 6 > 0",
        "fx_wide",
    ),
)
def p9l(spark, sf):
    """What each pick is worth to its side under the linear model."""
    return _linear(spark, sf).pick_impact(fx.drafts(spark, sf)).select("draft_id", "side", "role", "impact_pct")


@query("p10_swap_suggestions")
def p10(spark, sf):
    return _scorer(spark, sf).both_suggestions(fx.drafts(spark, sf), cut_lineage(lookups.meta_indicators(fx.wide(spark, sf))))


@query(
    "p14_retention",
    with_views(
        ", v AS (SELECT patch AS version, MAX(match_date) AS created, MAX(CASE WHEN patch = '5.2' THEN 1 ELSE 0 END) AS prod FROM fx_matches GROUP BY patch), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created DESC, version DESC) AS k FROM v) SELECT version FROM r WHERE k > 10 AND prod = 0",
        "fx_matches",
    ),
)
def p14(spark, sf):
    # one version per patch, created at its last match; 5.2 is in production
    h = fx.matches(spark, sf).select(F.col("patch").alias("version"), F.col("match_date").alias("created"), (F.col("patch") == "5.2").alias("is_production"))
    return lifecycle.retention(h, 10).select("version")


@query("p15_retrain")
def p15(spark, sf):
    return lifecycle.retrain(cut_lineage(fx.wide(spark, sf)))[2]


def _newton_sql(where: str, steps: int = 12) -> str:
    """Slope and intercept of the outcome on log-odds, with the ridge of C = 1 on the
    slope: Newton steps on the two numbers, written out."""
    out = f""", lo AS (SELECT model, LN(q / (1e0 - q)) AS x, SUM(y_true) AS y, COUNT(*) AS n FROM (SELECT model, y_true, ts, greatest(1e-10, least(1e0 - 1e-10, p)) AS q FROM fx_long) WHERE {where} GROUP BY 1, 2),
n0 AS (SELECT DISTINCT model, 0e0 AS a, 0e0 AS b FROM lo)"""
    for k in range(steps):
        out += f""",
g{k} AS (SELECT lo.model, s.a, s.b, n * (1e0 / (1e0 + exp(-(s.a + s.b * x)))) - y AS r, n * (1e0 / (1e0 + exp(-(s.a + s.b * x)))) * (1e0 - 1e0 / (1e0 + exp(-(s.a + s.b * x)))) AS w, x FROM lo JOIN n{k} s USING (model)),
h{k} AS (SELECT model, a, b, SUM(r) AS ga, SUM(r * x) + b AS gb, SUM(w) AS haa, SUM(w * x) AS hab, SUM(w * x * x) + 1e0 AS hbb FROM g{k} GROUP BY model, a, b),
n{k + 1} AS (SELECT model, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM h{k})"""
    return out + f", nw AS (SELECT * FROM n{steps})"


@query(
    "p15_retrain_rows",
    with_views(
        """, w AS (SELECT result, ROW_NUMBER() OVER (ORDER BY match_date, row_id) - 1 AS k, COUNT(*) OVER () AS n FROM fx_matches WHERE match_date >= (SELECT MAX(match_date) FROM fx_matches) - 360)
SELECT CASE WHEN k < FLOOR(n * 7e-1) THEN 'train' WHEN k < FLOOR(n * 85e-2) THEN 'val' ELSE 'test' END AS split, COUNT(*) AS rows, CAST(SUM(result) AS BIGINT) AS wins FROM w GROUP BY 1""",
        "fx_matches",
    ),
)
def p15r(spark, sf):
    """Which rows the retraining job learns from and is judged on."""
    report = lifecycle.retrain(cut_lineage(fx.wide(spark, sf)), min_rows=100)[2]
    return report.select("split", F.col("rows").cast("long").alias("rows"), (F.col("tp") + F.col("fn")).cast("long").alias("wins"))


@query("m6_calibration_slope", with_views(_newton_sql("true") + " SELECT model, ROUND(b, 4) AS slope, ROUND(a, 4) AS intercept FROM nw", "fx_long"))
def m6(spark, sf):
    p = preds(spark, sf)
    rows = [(m, *training.calibration_slope(p.filter(F.col("model") == m))) for m in ("a", "b")]
    return spark.createDataFrame(rows, "model string, slope double, intercept double").select("model", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _calibrated(spark, sf, methods):
    """Held-out rows of both models, raw and by each method fitted on the training rows."""
    out = []
    for model in ("a", "b"):
        p = preds(spark, sf).filter(F.col("model") == model)
        fit, held = p.filter("split = 'train'"), p.filter("split = 'val'")
        out.append(held.select("model", F.lit("raw").alias("method"), "y_true", "p"))
        out += [make(fit)(held).select("model", F.lit(name).alias("method"), "y_true", F.col("p_calibrated").alias("p")) for name, make in methods.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("m12_calibration")
def m12(spark, sf):
    return M.calibration_error(_calibrated(spark, sf, {"platt": training.platt, "isotonic": training.isotonic}), ["model", "method"])


_BIN = " + ".join(f"CAST(p > {i} * 1e-1 AS INT)" for i in range(10))


@query(
    "m12_platt",
    with_views(
        _newton_sql("ts < TIMESTAMP '2024-01-16'")
        + f""", hv AS (SELECT model, y_true, p FROM fx_long WHERE ts >= TIMESTAMP '2024-01-16'), al AS (SELECT model, 'raw' AS method, y_true, p FROM hv UNION ALL SELECT model, 'platt', y_true, 1e0 / (1e0 + exp(-(a + b * LN(p / (1e0 - p))))) FROM hv JOIN nw USING (model)),
bn AS (SELECT model, method, {_BIN} AS bin, COUNT(*) AS k, AVG(p) AS mp, AVG(CAST(y_true AS DOUBLE)) AS my FROM al GROUP BY 1, 2, 3)
SELECT model, method, ROUND(SUM(CASE WHEN bin > 0 THEN k * ABS(mp - my) ELSE 0 END) / SUM(k), 4) AS ece FROM bn GROUP BY model, method""",
        "fx_long",
    ),
)
def m12p(spark, sf):
    d = M.calibration_error(_calibrated(spark, sf, {"platt": training.platt}), ["model", "method"])
    return d.select("model", "method", F.round("ece", 4).alias("ece"))
