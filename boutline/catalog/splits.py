"""Queries over splits, folds, weights and top-k."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import day, query, r6
from boutline.fixtures import with_views
from boutline.operators import form, lookups, splits

_TAG = "CASE WHEN k < FLOOR(n * 7e-1) THEN 'train' WHEN k < FLOOR(n * 85e-2) THEN 'val' ELSE 'test' END"
_G = "SELECT *, ROW_NUMBER() OVER (ORDER BY match_date, row_id) - 1 AS k, COUNT(*) OVER () AS n FROM fx_matches"
_Y = "SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY match_date, row_id) - 1 AS k, COUNT(*) OVER (PARTITION BY year) AS n FROM fx_matches"


@query("w15_temporal_split", with_views(f"SELECT row_id, {_TAG} AS split FROM ({_G})", "fx_matches"))
def w15(spark, sf):
    return splits.temporal_split(fx.matches(spark, sf)).select("row_id", "split")


@query("w16_stratified_temporal", with_views(f"SELECT row_id, {_TAG} AS split FROM ({_Y}) WHERE n >= 10", "fx_matches"))
def w16(spark, sf):
    return splits.stratified_temporal_split(fx.matches(spark, sf)).select("row_id", "split")


def _md5(part):
    return f"ROW_NUMBER() OVER (PARTITION BY {part} ORDER BY md5('42-' || CAST(year AS VARCHAR) || '-' || CAST(row_id AS VARCHAR)), row_id) - 1 AS k, COUNT(*) OVER (PARTITION BY {part}) AS n"


@query("w17_stratified_random", with_views(f"SELECT row_id, {_TAG} AS split FROM (SELECT *, {_md5('year')} FROM fx_matches) WHERE n >= 10", "fx_matches"))
def w17(spark, sf):
    return splits.stratified_random_split(fx.matches(spark, sf)).select("row_id", "split")


@query("w17_label_stratified", with_views(f"SELECT row_id, {_TAG} AS split FROM (SELECT *, {_md5('year, result')} FROM fx_matches) WHERE n >= 10", "fx_matches"))
def w17l(spark, sf):
    return splits.stratified_random_split(fx.matches(spark, sf), by_label=True).select("row_id", "split")


@query(
    "w18_stratified_folds",
    with_views(
        """, s AS (SELECT row_id, year, ROW_NUMBER() OVER (PARTITION BY year ORDER BY md5('cv-' || CAST(year AS VARCHAR) || '-' || CAST(row_id AS VARCHAR)), row_id) - 1 AS k, COUNT(*) OVER (PARTITION BY year) AS n FROM fx_matches),
v AS (SELECT *, GREATEST(FLOOR(n * 2e-1), 1) AS v FROM s WHERE n >= 5),
f AS (SELECT v.*, i AS fold, (i * FLOOR(n / 5e0)) % GREATEST(n - v, 1) AS st FROM v, (SELECT UNNEST([0, 1, 2, 3, 4]) AS i))
SELECT fold, row_id, CASE WHEN k >= st AND k < st + v THEN 'val' ELSE 'train' END AS role FROM f""",
        "fx_matches",
    ),
)
def w18(spark, sf):
    return splits.stratified_folds(fx.matches(spark, sf)).select("fold", "row_id", "role")


def _expand(name, windows):
    rows = ", ".join(f"({i}, {e!r}e0, {min(e + v, 1.0)!r}e0)" for i, (e, v) in enumerate(windows))
    return with_views(
        f""", g AS ({_G}), w(fold, a, b) AS (VALUES {rows})
SELECT fold, row_id, CASE WHEN k < FLOOR(n * a) THEN 'train' ELSE 'val' END AS role FROM g JOIN w ON k < FLOOR(n * b)""",
        "fx_matches",
    )


@query("w19_expanding_folds", _expand("o", splits.OUTER_WINDOWS))
def w19(spark, sf):
    return splits.expanding_folds(fx.matches(spark, sf)).select("fold", "row_id", "role")


@query("w19_inner_folds", _expand("i", splits.INNER_WINDOWS))
def w19i(spark, sf):
    return splits.expanding_folds(fx.matches(spark, sf), splits.INNER_WINDOWS).select("fold", "row_id", "role")


@query("w23_block_folds", with_views(f"SELECT row_id, CAST(LEAST(FLOOR(k / FLOOR(n / 5e0)), 4) AS INT) AS fold FROM ({_G})", "fx_matches"))
def w23(spark, sf):
    return splits.block_folds(fx.matches(spark, sf)).select("row_id", "fold")


@query(
    "w14_temporal_samples",
    with_views(
        """, r AS (SELECT team, match_date, result, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date, row_id) AS rn FROM fx_matches),
f AS (SELECT *, AVG(CAST(result AS DOUBLE)) OVER w AS m, COUNT(*) OVER w AS c, MIN(match_date) OVER w AS a, MAX(match_date) OVER w AS b FROM r WINDOW w AS (PARTITION BY team ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT team, CAST((rn - 1) // 5 AS BIGINT) AS sample, ROUND(m, 6) AS mean_outcome, c AS window_size, strftime(a, '%Y-%m-%d') AS first_date, strftime(b, '%Y-%m-%d') AS last_date FROM f WHERE (rn - 1) % 5 = 0 AND c = 10""",
        "fx_matches",
    ),
)
def w14(spark, sf):
    d = splits.temporal_samples(fx.matches(spark, sf))
    return d.select("team", "sample", r6("mean_outcome"), "window_size", day("first_date"), day("last_date"))


@query(
    "w20_temporal_weights",
    with_views(
        """, a AS (SELECT row_id, CAST((SELECT MAX(match_date) FROM fx_matches) - match_date AS INT) AS d, CAST((SELECT MAX(match_date) - MIN(match_date) FROM fx_matches) AS INT) AS md FROM fx_matches)
SELECT row_id, ROUND(GREATEST(1e-1, LEAST(1e0, EXP(-LN(2e0) / 18e1 * d))), 6) AS exponential, ROUND(GREATEST(1e-1, LEAST(1e0, 1e0 - d / (md + 1e0))), 6) AS linear,
  CASE WHEN d < 180 THEN 1e0 WHEN d < 365 THEN 7e-1 ELSE 4e-1 END AS step FROM a""",
        "fx_matches",
    ),
)
def w20(spark, sf):
    m = fx.matches(spark, sf)
    ref, old = m.agg(F.max("match_date")).scalar(), m.agg(F.min("match_date")).scalar()
    d, md = F.datediff(ref, F.col("match_date")), F.datediff(ref, old)
    return m.select("row_id", *[r6(splits.temporal_weight(d, k, max_days=md), k) for k in ("exponential", "linear", "step")])


_PN = "CAST(split_part(patch, '.', 1) AS INT) * 100 + CAST(split_part(patch, '.', 2) AS INT)"


@query(
    "w21_combined_weights",
    with_views(
        f""", c AS (SELECT {_PN} AS v FROM fx_matches ORDER BY match_date DESC, row_id DESC LIMIT 1),
a AS (SELECT row_id, GREATEST(1e-1, LEAST(1e0, EXP(-LN(2e0) / 18e1 * CAST((SELECT MAX(match_date) FROM fx_matches) - match_date AS INT)))) AS t,
  GREATEST(1e-1, LEAST(1e0, POW(8e-1, ABS((SELECT v FROM c) - ({_PN}))))) AS p FROM fx_matches)
SELECT row_id, ROUND(p, 6) AS patch_weight, ROUND((6e-1 * t + 4e-1 * p) * (SELECT COUNT(*) / SUM(6e-1 * t + 4e-1 * p) FROM a), 6) AS sample_weight FROM a""",
        "fx_matches",
    ),
)
def w21(spark, sf):
    return splits.combined_weights(fx.matches(spark, sf)).select("row_id", r6("patch_weight"), r6("sample_weight"))


@query(
    "w22_split_presets",
    with_views(
        f""", g AS ({_G}), p(preset, a, b) AS (VALUES ('70_15_15', 7e-1, 7e-1 + 15e-2), ('60_20_20', 6e-1, 6e-1 + 2e-1), ('70_20_10', 7e-1, 7e-1 + 2e-1))
SELECT preset, CASE WHEN k < FLOOR(n * a) THEN 'train' WHEN k < FLOOR(n * b) THEN 'val' ELSE 'test' END AS split, COUNT(*) AS rows, strftime(MIN(match_date), '%Y-%m-%d') AS first_date FROM g, p GROUP BY 1, 2""",
        "fx_matches",
    ),
)
def w22(spark, sf):
    m = fx.matches(spark, sf)
    d = splits.time_rank(m, []).withColumn("_n", m.agg(F.count("*")).scalar())
    tags = F.array(*[F.struct(F.lit(n).alias("preset"), splits.tag(F.col("_rank"), F.col("_n"), a, b).alias("split")) for n, (a, b, _) in splits.PRESETS.items()])
    return d.select("match_date", F.explode(tags).alias("x")).groupBy("x.preset", "x.split").agg(F.count("*").alias("rows"), day_min()).select("preset", "split", "rows", "first_date")


def day_min():
    return F.date_format(F.min("match_date"), "yyyy-MM-dd").alias("first_date")


@query(
    "flagship_form_by_split",
    with_views(
        f""", f AS (SELECT row_id, year, match_date, league, COALESCE(AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY team ORDER BY match_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5e-1) AS o,
 COALESCE(AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY team ORDER BY match_date, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 5e-1) AS r FROM fx_matches),
s AS (SELECT row_id, {_TAG} AS split FROM ({_Y}) WHERE n >= 10)
SELECT split, league, COUNT(*) AS rows, ROUND(AVG(o), 6) AS overall, ROUND(AVG(r), 6) AS recent, ROUND(AVG(r - o), 6) AS trend FROM f JOIN s USING (row_id) GROUP BY 1, 2""",
        "fx_matches",
    ),
)
def flagship(spark, sf):
    """Form of every team before every game, by stratified split and league."""
    d = splits.stratified_temporal_split(form.entity_form(fx.matches(spark, sf)))
    g = splits.split_summary(d, {"overall": "overall_winrate", "recent": "recent_winrate", "trend": "form_trend"}, ["split", "league"])
    return g.select("split", "league", "rows", r6("overall"), r6("recent"), r6("trend"))


@query("k1_chronological", with_views("SELECT row_id, strftime(match_date, '%Y-%m-%d') AS match_date, result FROM fx_matches ORDER BY match_date, row_id", "fx_matches"))
def k1(spark, sf):
    return fx.matches(spark, sf).orderBy("match_date", "row_id").select("row_id", day("match_date"), "result")


@query(
    "k2_first_last",
    with_views(
        """SELECT 'first' AS part, row_id, result FROM (SELECT * FROM fx_matches ORDER BY match_date, row_id LIMIT 1000)
UNION ALL SELECT 'last', row_id, result FROM (SELECT * FROM fx_matches ORDER BY match_date DESC, row_id DESC LIMIT 1000)""",
        "fx_matches",
    ),
)
def k2(spark, sf):
    # the first and last thousand rows are the operator itself
    return splits.first_last(fx.matches(spark, sf), 1000).select("part", "row_id", "result")


@query(
    "k3_top_per_patch",
    with_views(
        "SELECT patch, team, wins, place FROM (SELECT patch, team, CAST(SUM(result) AS BIGINT) AS wins, ROW_NUMBER() OVER (PARTITION BY patch ORDER BY SUM(result) DESC, team) AS place FROM fx_matches GROUP BY 1, 2) WHERE place <= 5",
        "fx_matches",
    ),
)
def k3(spark, sf):
    from pyspark.sql import Window

    g = fx.matches(spark, sf).groupBy("patch", "team").agg(F.sum("result").alias("wins"))
    w = Window.partitionBy("patch").orderBy(F.desc("wins"), "team")
    return g.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5")


@query("a9_sample_of_year", with_views("SELECT row_id, team, result FROM fx_matches WHERE year = 1996 ORDER BY match_date, row_id LIMIT 100", "fx_matches"))
def a9(spark, sf):
    # the first n rows of a year are the operator itself
    return splits.sample_rows(fx.matches(spark, sf), 1996, 100).select("row_id", "team", "result")


@query(
    "d26_tier_mix",
    with_views(
        f""", s AS (SELECT team, {_TAG} AS split FROM ({_G})), t AS (SELECT team, AVG(CAST(result AS DOUBLE)) AS w FROM fx_matches GROUP BY team),
u AS (SELECT split, CASE WHEN w <= 0 THEN NULL WHEN w <= 3e-1 THEN 'Low' WHEN w <= 45e-2 THEN 'Below_Avg' WHEN w <= 55e-2 THEN 'Average' WHEN w <= 7e-1 THEN 'Above_Avg' ELSE 'High' END AS tier FROM s JOIN t USING (team))
SELECT split, tier, COUNT(*) AS rows, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split), 6) AS share FROM u WHERE tier IS NOT NULL GROUP BY 1, 2""",
        "fx_matches",
    ),
)
def d26m(spark, sf):
    return lookups.tier_mix(splits.temporal_split(fx.matches(spark, sf)), "split").select("split", "tier", "rows", r6("share"))
