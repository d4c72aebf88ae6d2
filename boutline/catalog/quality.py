"""Queries over data quality, outliers and leakage."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import day, query, r6
from boutline.fixtures import table, with_views
from boutline.operators import encoding, quality
from boutline.roles import Roles

NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUM)


_B = ", ".join(f"quantile_cont({c}, 25e-2) AS a_{c}, quantile_cont({c}, 75e-2) AS b_{c}" for c in NUM)
_OUT = " OR ".join(f"{c} < a_{c} - 15e-1 * (b_{c} - a_{c}) OR {c} > b_{c} + 15e-1 * (b_{c} - a_{c})" for c in NUM)


@query(
    "d20_outliers_iqr",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(quantile_cont({c}, 25e-2) - 15e-1 * (quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2)), 6) AS lower, ROUND(quantile_cont({c}, 75e-2) + 15e-1 * (quantile_cont({c}, 75e-2) - quantile_cont({c}, 25e-2)), 6) AS upper FROM lineitem" for c in NUM),
)
def d20(spark, sf):
    return quality.outlier_bounds(_lines(spark, sf), NUM).select("feature", r6("lower"), r6("upper"))


@query(
    "d20_outliers_zscore",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, (SELECT AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS s FROM lineitem) WHERE ABS((l_extendedprice - m) / s) > 16e-1",
)
def d20z(spark, sf):
    d = _lines(spark, sf)
    flagged = quality.flag_outliers(d, quality.outlier_bounds(d, ["l_extendedprice"], "zscore", 1.6), ["l_extendedprice"])
    return flagged.filter("is_outlier").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "d18_quality_report",
    f"""WITH b AS (SELECT {_B} FROM lineitem), o AS (SELECT AVG(CASE WHEN {_OUT} THEN 1e0 ELSE 0e0 END) AS s FROM lineitem, b),
d2 AS (SELECT SUM(n - 1) AS x FROM (SELECT l_orderkey, l_linenumber, {', '.join(NUM)}, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, {', '.join(NUM)})), n AS (SELECT COUNT(*) AS n FROM lineitem)
SELECT n AS rows, 0e0 AS null_pct, 1 AS missing_columns, ROUND(x / CAST(n AS DOUBLE) * 1e2, 6) AS duplicate_pct, ROUND(s, 6) AS outlier_share,
 ROUND(95e0 - LEAST(x / CAST(n AS DOUBLE) * 1e2, 1e1) - LEAST(s * 5e1, 1e1), 6) AS score FROM n, d2, o""",
)
def d18(spark, sf):
    d = quality.quality_report(_lines(spark, sf), ["l_orderkey", "patch"], NUM)
    return d.select("rows", r6("null_pct"), "missing_columns", r6("duplicate_pct"), r6("outlier_share"), r6("score"))


@query("d18_null_counts", with_views("SELECT 'row_id' AS column_name, 0 AS nulls, 0e0 AS null_pct UNION ALL SELECT 'patch', COUNT(*) FILTER (WHERE row_id % 3 = 0), ROUND(COUNT(*) FILTER (WHERE row_id % 3 = 0) * 1e2 / COUNT(*), 6) FROM fx_matches", "fx_matches"))
def d18n(spark, sf):
    m = fx.matches(spark, sf).select("row_id", F.when(F.col("row_id") % 3 != 0, F.col("patch")).alias("patch"))
    return quality.null_counts(m).select("column_name", "nulls", r6("null_pct"))


@query("d18_rows_per_year", with_views("SELECT year, COUNT(*) AS rows FROM fx_matches GROUP BY year", "fx_matches"))
def d18y(spark, sf):
    return fx.matches(spark, sf).groupBy("year").agg(F.count("*").alias("rows"))


@query(
    "d19_temporal_integrity",
    with_views(
        """, d AS (SELECT match_date AS d, COUNT(*) AS n FROM fx_matches GROUP BY 1), g AS (SELECT d, n, COALESCE(d - LAG(d) OVER (ORDER BY d), 0) AS gap FROM d)
SELECT CAST(SUM(CASE WHEN d > DATE '1999-06-01' THEN n ELSE 0 END) AS BIGINT) AS future_rows, strftime(MIN(d), '%Y-%m-%d') AS first_date, strftime(MAX(d), '%Y-%m-%d') AS last_date, CAST(MAX(gap) AS INT) AS longest_gap, COUNT(*) FILTER (WHERE gap > 1) AS long_gaps FROM g""",
        "fx_matches",
    ),
)
def d19(spark, sf):
    # games are daily: a day without any is a long gap here
    d = quality.temporal_integrity(fx.matches(spark, sf), F.lit("1999-06-01").cast("date"), max_gap=1)
    return d.select("future_rows", day("first_date"), day("last_date"), "longest_gap", "long_gaps")


@query(
    "d24_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max, ROUND(quantile_cont({c}, 25e-2), 6) AS q25, ROUND(quantile_cont({c}, 5e-1), 6) AS q50, ROUND(quantile_cont({c}, 75e-2), 6) AS q75 FROM lineitem"
        for c in NUM
    ),
)
def d24(spark, sf):
    d = quality.describe(_lines(spark, sf), NUM)
    return d.select("feature", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *[r6(c) for c in ("min", "max", "q25", "q50", "q75")])


_FINE = Roles(entity="grp")


@query(
    "d22_leakage_findings",
    with_views(
        """, w AS (SELECT *, team || '_' || CAST(year AS VARCHAR) || '_' || CAST(o_custkey % 40 AS VARCHAR) AS grp FROM fx_matches), x AS (SELECT w.grp, w.result, p.* FROM w JOIN (SELECT row_id AS rid, top_champion, jng_champion, mid_champion, bot_champion, sup_champion FROM fx_wide) p ON w.row_id = p.rid),
t AS (SELECT grp, COUNT(*) AS n, AVG(CAST(result AS DOUBLE)) AS m FROM w GROUP BY grp),
c AS (SELECT 'top' AS role, top_champion AS champion, result FROM x UNION ALL SELECT 'jungle', jng_champion, result FROM x UNION ALL SELECT 'mid', mid_champion, result FROM x UNION ALL SELECT 'bot', bot_champion, result FROM x UNION ALL SELECT 'support', sup_champion, result FROM x),
cm AS (SELECT role, champion, AVG(CAST(result AS DOUBLE)) AS m FROM c WHERE champion <> 'Unknown' GROUP BY 1, 2)
SELECT 'high_rate_team' AS kind, grp AS name, ROUND(m, 6) AS value FROM t WHERE m > 7e-1 UNION ALL SELECT 'low_rate_team', grp, ROUND(m, 6) FROM t WHERE m < 3e-1 UNION ALL SELECT 'small_sample_team', grp, ROUND(m, 6) FROM t WHERE n < 10
UNION ALL SELECT CASE WHEN m > 8e-1 THEN 'high_rate_champion' ELSE 'low_rate_champion' END, role || ':' || champion, ROUND(m, 6) FROM cm WHERE m > 8e-1 OR m < 2e-1""",
        "fx_matches", "fx_wide",
    ),
)
def d22(spark, sf):
    # nations are too large to be extreme: entities are customer groups within a year
    w = fx.wide(spark, sf)
    cust = fx.matches(spark, sf).select("row_id", "o_custkey")
    d = w.join(cust, "row_id").withColumn("grp", F.concat_ws("_", "team", F.col("year").cast("string"), (F.col("o_custkey") % 40).cast("string")))
    return quality.leakage_findings(d, _FINE).select("kind", "name", r6("value"))


@query(
    "d22_encoding_drift",
    with_views(
        """, e AS (SELECT match_date, row_id, (SUM(result) OVER (PARTITION BY team) - result) / CAST(COUNT(*) OVER (PARTITION BY team) - 1 AS DOUBLE) AS v FROM fx_matches),
a AS (SELECT (SELECT AVG(v) FROM (SELECT v FROM e ORDER BY match_date, row_id LIMIT 1000)) AS f, (SELECT AVG(v) FROM (SELECT v FROM e ORDER BY match_date DESC, row_id DESC LIMIT 1000)) AS l)
SELECT ROUND(f, 6) AS first_mean, ROUND(l, 6) AS last_mean, ROUND(ABS(f - l), 6) AS difference, CAST(ABS(f - l) > 5e-2 AS INT) AS drifts FROM a""",
        "fx_matches",
    ),
)
def d22e(spark, sf):
    # the first and last thousand rows are what the check compares
    m = encoding.leave_one_out(fx.matches(spark, sf), "team")
    d = quality.encoding_drift(m, "team_loo_encoded", 1000)
    return d.select(r6("first_mean"), r6("last_mean"), r6("difference"), F.col("drifts").cast("int").alias("drifts"))


_SFA = ["year", "gameid", "blue"]


@query(
    "d22_single_feature_auc",
    with_views(
        ", f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({c} AS DOUBLE) AS v, result AS y FROM fx_matches" for n, c in zip(_SFA, ["year", "gameid", "CASE WHEN side = 'Blue' THEN 1 ELSE 0 END"])) + """),
c AS (SELECT feature, v, CAST(SUM(y) AS DOUBLE) AS p, CAST(SUM(1 - y) AS DOUBLE) AS q FROM f GROUP BY 1, 2), b AS (SELECT *, COALESCE(SUM(q) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS z FROM c)
SELECT feature, ROUND(SUM(p * (z + q / 2e0)) / (SUM(p) * SUM(q)), 6) AS auc, 0 AS suspicious FROM b GROUP BY feature""",
        "fx_matches",
    ),
)
def d22a(spark, sf):
    m = fx.matches(spark, sf).withColumn("blue", (F.col("side") == "Blue").cast("int"))
    return quality.single_feature_auc(m, _SFA).select("feature", r6("auc"), F.col("suspicious").cast("int").alias("suspicious"))


@query(
    "j8_nearest_in_time",
    with_views(
        """, k AS (SELECT row_id, match_date, CASE WHEN row_id % 7 = 0 THEN team END AS p FROM fx_matches)
SELECT row_id, COALESCE(p, CASE WHEN na IS NULL OR match_date - nbd <= nad - match_date THEN nb ELSE na END) AS p FROM (SELECT *,
 LAST_VALUE(p IGNORE NULLS) OVER w1 AS nb, LAST_VALUE(CASE WHEN p IS NOT NULL THEN match_date END IGNORE NULLS) OVER w1 AS nbd, FIRST_VALUE(p IGNORE NULLS) OVER w2 AS na, FIRST_VALUE(CASE WHEN p IS NOT NULL THEN match_date END IGNORE NULLS) OVER w2 AS nad
 FROM k WINDOW w1 AS (ORDER BY match_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (ORDER BY match_date, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
        "fx_matches",
    ),
)
def j8(spark, sf):
    m = fx.matches(spark, sf).select("row_id", "match_date", F.when(F.col("row_id") % 7 == 0, F.col("team")).alias("p"))
    return quality.nearest_in_time(m, "p").select("row_id", "p")
