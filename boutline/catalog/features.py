"""Queries over feature vectors."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.catalog.form import _SHIFT
from boutline.catalog.lookups import _L, _LANE, _META, _PEERSUM
from boutline.fixtures import with_views
from boutline.operators import features, form, splits
from boutline.operators.features import CANONICAL_48, PLAYER_7, FeatureModel
from boutline.roles import ROLE_PREFIX
from boutline.session import cut_lineage

_CHAMP = [f"{p}_champion" for p in ROLE_PREFIX]
_TE = {"league": "league", "team": "team", "patch": "patch", "split": "split_name", **{c: c for c in _CHAMP}}
_ROLES5 = "[{'r': 'top', 'c': top_champion}, {'r': 'jungle', 'c': jng_champion}, {'r': 'mid', 'c': mid_champion}, {'r': 'bot', 'c': bot_champion}, {'r': 'support', 'c': sup_champion}]"


def vector_sql(train: str, rows: str, past: str) -> str:
    """The 48 features of ``rows`` with everything fitted on ``train``."""
    lk = (_L + _META + _LANE + _PEERSUM).replace("fx_wide", "fx_src").replace("fx_matches", "fx_src")
    enc = "".join(
        f", te_{k} AS (SELECT {c} AS k, COUNT(*) AS n, AVG(CAST(result AS DOUBLE)) AS m FROM fx_src GROUP BY 1),\nee_{k} AS (SELECT k, (n * gm * (1e0 - gm) * m + m * (1e0 - m) * gm) / (m * (1e0 - m) + n * gm * (1e0 - gm)) AS e FROM te_{k}, gmean)"
        for k, c in _TE.items()
    )
    if past == "rows":
        w = "(PARTITION BY team ORDER BY match_date, row_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
        hist = f"""hs AS (SELECT row_id, COALESCE(AVG(CAST(result AS DOUBLE)) OVER {w.format('UNBOUNDED')}, 5e-1) AS ov, COALESCE(AVG(CAST(result AS DOUBLE)) OVER {w.format(10)}, 5e-1) AS rc,
 LEAST(COUNT(*) OVER {w.format('UNBOUNDED')} / 1e2, 1e0) AS ex FROM rowsx)"""
    else:
        hist = """sn AS (SELECT team, AVG(CAST(result AS DOUBLE)) AS ov, AVG(CASE WHEN k <= 10 THEN CAST(result AS DOUBLE) END) AS rc, LEAST(COUNT(*) / 1e2, 1e0) AS ex FROM
 (SELECT team, result, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, row_id DESC) AS k FROM fx_src) GROUP BY team),
hs AS (SELECT row_id, COALESCE(ov, 5e-1) AS ov, COALESCE(rc, 5e-1) AS rc, COALESCE(ex, 0e0) AS ex FROM rowsx LEFT JOIN sn USING (team))"""
    return f""", fx_src AS ({train}), rowsx AS ({rows}){lk}, gmean AS (SELECT AVG(CAST(result AS DOUBLE)) AS gm FROM fx_src){enc},
{hist},
rl AS (SELECT row_id, patch, x.r AS role, x.c AS champion FROM (SELECT row_id, patch, UNNEST({_ROLES5}) AS x FROM rowsx)),
c1 AS (SELECT rl.row_id, COALESCE(AVG(CASE WHEN rl.champion <> 'Unknown' THEN COALESCE(chars.win_rate, 5e-1) END), 5e-1) AS team_avg_winrate,
 COALESCE(AVG(CASE WHEN rl.champion <> 'Unknown' THEN CAST(COALESCE(flexibility, 1) AS DOUBLE) END), 1e0) AS team_flexibility, CAST(COUNT(*) FILTER (WHERE rl.champion <> 'Unknown') AS INT) AS champion_count,
 COALESCE(AVG(CASE WHEN rl.champion <> 'Unknown' THEN COALESCE(meta_strength, 5e-1) END), 5e-1) AS team_meta_strength,
 1e0 - COALESCE(STDDEV_SAMP(CASE WHEN rl.champion <> 'Unknown' THEN COALESCE(meta_strength, 5e-1) END), 0e0) AS team_meta_consistency,
 COALESCE(AVG(CASE WHEN rl.champion <> 'Unknown' THEN COALESCE(popularity, 0e0) END), 0e0) AS team_popularity,
 AVG(COALESCE(lane_advantage, 5e-1)) AS team_lane_advantage, 1e0 - STDDEV_SAMP(COALESCE(lane_advantage, 5e-1)) AS lane_advantage_consistency, AVG(COALESCE(lane_confidence, 1e-1)) AS lane_matchup_confidence,
 MAX(COALESCE(lane_advantage, 5e-1)) AS strongest_lane_advantage, MIN(COALESCE(lane_advantage, 5e-1)) AS weakest_lane_advantage, COUNT(*) FILTER (WHERE COALESCE(lane_advantage, 5e-1) > 55e-2) AS lanes_with_advantage,
 AVG(COALESCE(archetype_advantage, 5e-1)) AS team_archetype_advantage
 FROM rl LEFT JOIN chars ON rl.champion = chars.champion LEFT JOIN meta ON rl.patch = meta.patch AND rl.champion = meta.champion LEFT JOIN lane ON rl.role = lane.role AND rl.champion = lane.champion GROUP BY rl.row_id),
bp AS (SELECT champion FROM bl GROUP BY champion HAVING COUNT(*) FILTER (WHERE pos < 2) > COUNT(*) * 5e-1),
b1 AS (SELECT row_id, COUNT(*) FILTER (WHERE b <> 'NoBan') AS ban_count, COUNT(DISTINCT CASE WHEN b <> 'NoBan' THEN b END) AS ban_diversity, COUNT(bp.champion) AS high_priority_bans
 FROM (SELECT row_id, UNNEST([ban1, ban2, ban3, ban4, ban5]) AS b FROM rowsx) LEFT JOIN bp ON b = bp.champion GROUP BY row_id),
vec AS (SELECT r.*, c1.* EXCLUDE (row_id), b1.* EXCLUDE (row_id), 5e-1 AS team_early_strength, 5e-1 AS team_late_strength, 0e0 AS team_scaling, 0e0 AS composition_balance, team_meta_strength - 5e-1 AS meta_advantage,
 ov AS team_overall_winrate, rc AS team_recent_winrate, rc - ov AS team_form_trend, ex AS team_experience, 5e-1 AS composition_historical_winrate, CASE WHEN r.side = 'Blue' THEN 1 ELSE 0 END AS side_blue,
 team_meta_strength * (rc - ov) AS meta_form_interaction, 0e0 AS scaling_experience_interaction, COALESCE(adv, 5e-1) AS team_historical_advantage, COALESCE(cons, 1e0) AS team_matchup_consistency,
 COALESCE(fav, 0) AS favorable_matchups, COALESCE(unf, 0) AS unfavorable_matchups, team_lane_advantage * team_meta_strength AS lane_meta_synergy, ex * lane_matchup_confidence AS experience_matchup_confidence,
 (rc - ov) * COALESCE(adv, 5e-1) AS form_matchup_interaction, 0e0 AS scaling_lane_advantage, {", ".join(f"COALESCE(ee_{k}.e, gm) AS {k}_target_encoded" for k in _TE)}
 FROM rowsx r JOIN c1 USING (row_id) JOIN b1 USING (row_id) JOIN hs USING (row_id) LEFT JOIN ps ON r.team = ps.team CROSS JOIN gmean
 {" ".join(f"LEFT JOIN ee_{k} ON r.{c} = ee_{k}.k" for k, c in _TE.items())})
"""


# Means of few rates often end in an exact 5 at the seventh digit; the nudge makes
# both engines round such ties the same way.
def _round(names):
    return ", ".join(f"ROUND(CAST({n} AS DOUBLE) + 1e-9, 6) AS {n}" for n in names)


ALL = ("SELECT * FROM fx_wide", "SELECT * FROM fx_wide", "rows")
TRAIN = "SELECT * FROM fx_wide WHERE year < 1998"


def _v(names, args=ALL):
    return with_views(vector_sql(*args) + f"SELECT row_id, {_round(names)} FROM vec", "fx_wide")


def _landed(spark, sf):
    """The match table as a job would find it: written once, read by every step."""
    return cut_lineage(fx.wide(spark, sf))


def _out(d, names, key="row_id"):
    return d.select(key, *[r6(F.col(n).cast("double") + 1e-9, n) for n in names])


V1 = CANONICAL_48[:6]
V2 = CANONICAL_48[6:10]
V3 = CANONICAL_48[10:13]
V4 = CANONICAL_48[13:17]
V6 = ("playoffs", "side_blue", "year", "champion_count")
V7 = ("meta_form_interaction", "scaling_experience_interaction", "lane_meta_synergy", "experience_matchup_confidence", "form_matchup_interaction", "scaling_lane_advantage")
V8 = CANONICAL_48[24:31]


@query("v1_composition_features", _v(V1))
def v1(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).composition(w), V1)


@query("v2_meta_features", _v(V2))
def v2(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).meta(w), V2)


@query("v3_ban_features", _v(V3))
def v3(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).bans(w), V3)


@query("v4_team_history", _v(V4))
def v4(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).past(w, "rows"), V4)


_PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_PLAYER = f""", pl AS (SELECT row_id, match_date, result, UNNEST([{", ".join("{'p': " + p + "_player, 'c': " + p + "_champion}" for p in ROLE_PREFIX)}]) AS x FROM fx_wide),
ph AS (SELECT row_id, COALESCE(AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY x.p ORDER BY match_date, row_id {_PREV}), 5e-1) AS w, COALESCE(AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY x.p ORDER BY match_date, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 5e-1) AS r,
 LEAST(COUNT(*) OVER (PARTITION BY x.p ORDER BY match_date, row_id {_PREV}) / 1e2, 1e0) AS g, COALESCE(AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY x.p, x.c ORDER BY match_date, row_id {_PREV}), 5e-1) AS m FROM pl)
SELECT row_id, ROUND(AVG(w) + 1e-9, 6) AS team_avg_player_winrate, ROUND(AVG(r) + 1e-9, 6) AS team_avg_player_recent, ROUND(AVG(g) + 1e-9, 6) AS team_avg_player_experience, ROUND(AVG(m) + 1e-9, 6) AS team_avg_champion_mastery,
 ROUND(MIN(m) + 1e-9, 6) AS team_min_champion_mastery, ROUND(AVG(r - w) + 1e-9, 6) AS team_player_form, ROUND(AVG(m) * AVG(g) + 1e-9, 6) AS player_mastery_experience_interaction FROM ph GROUP BY row_id"""


@query("v5_player_features", with_views(_PLAYER, "fx_wide"))
def v5(spark, sf):
    return _out(form.player_features(fx.wide(spark, sf)), PLAYER_7)


@query("v6_context", _v(V6))
def v6(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).context(w), V6)


@query("v7_interactions", _v(V7))
def v7(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).transform(w, "rows"), V7)


@query("v8_lane_vector", _v(V8))
def v8(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).lanes(w), V8)


ENH = (
    "games_on_patch", "early_patch_indicator", "games_on_patch_normalized", "patch_experience_advantage", "blue_side_winrate", "red_side_winrate",
    "side_preference", "current_side_advantage", "side_meta_interaction", "patch_win_rate", "patch_adaptation_rate", "league_specific_winrate",
    "league_dominance", "cross_league_experience", "meta_side_synergy", "experience_adaptation_interaction", "form_matchup_synergy",
    "composition_aggression", "strategic_meta_interaction", "confidence_weighted_meta", "momentum_experience_synergy", "h2h_momentum",
    "patch_stability", "pick_shift_magnitude",
)
_TW = "(PARTITION BY team ORDER BY match_date, row_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_ENH = vector_sql(*ALL) + _SHIFT + f""", gp AS (SELECT row_id, COUNT(*) OVER (PARTITION BY team, patch ORDER BY match_date, row_id {_PREV}) AS gop,
 COALESCE(AVG(CAST(result AS DOUBLE)) OVER {_TW.format(3)}, 5e-1) - COALESCE(AVG(CAST(result AS DOUBLE)) OVER {_TW.format(10)}, 5e-1) AS mom FROM fx_wide),
t0 AS (SELECT team, AVG(CAST(result AS DOUBLE)) AS o, LEAST(COUNT(DISTINCT league) / 5e0, 1e0) AS cle, COALESCE(AVG(CASE WHEN side = 'Blue' THEN CAST(result AS DOUBLE) END), 5e-1) AS b, COALESCE(AVG(CASE WHEN side = 'Red' THEN CAST(result AS DOUBLE) END), 5e-1) AS rd FROM fx_wide GROUP BY team),
t1 AS (SELECT team, patch, AVG(CAST(result AS DOUBLE)) AS pw FROM fx_wide GROUP BY 1, 2), t2 AS (SELECT team, league, AVG(CAST(result AS DOUBLE)) AS lw FROM fx_wide GROUP BY 1, 2),
en AS (SELECT v.row_id, gop AS games_on_patch, CASE WHEN gop < 3 THEN 1 ELSE 0 END AS early_patch_indicator, LEAST(gop / 2e1, 1e0) AS games_on_patch_normalized, CASE WHEN gop < 3 THEN 0e0 ELSE LEAST(gop / 2e1, 1e0) END AS patch_experience_advantage,
 t0.b AS blue_side_winrate, rd AS red_side_winrate, t0.b - rd AS side_preference, CASE WHEN v.side = 'Blue' THEN t0.b ELSE rd END AS current_side_advantage, CASE WHEN v.side = 'Blue' THEN t0.b ELSE rd END * team_meta_strength AS side_meta_interaction,
 pw AS patch_win_rate, pw - o AS patch_adaptation_rate, lw AS league_specific_winrate, lw - o AS league_dominance, cle AS cross_league_experience, CASE WHEN v.side = 'Blue' THEN t0.b ELSE rd END * team_meta_strength AS meta_side_synergy,
 team_experience * (pw - o + 5e-1) AS experience_adaptation_interaction, team_recent_winrate * team_historical_advantage AS form_matchup_synergy, 0e0 AS composition_aggression, ban_diversity / 5e0 * team_meta_strength AS strategic_meta_interaction,
 team_meta_strength * lane_matchup_confidence AS confidence_weighted_meta, mom * team_experience AS momentum_experience_synergy, lw * team_recent_winrate AS h2h_momentum, stab AS patch_stability, fin.m AS pick_shift_magnitude
 FROM vec v JOIN gp ON v.row_id = gp.row_id JOIN t0 ON v.team = t0.team JOIN t1 ON v.team = t1.team AND v.patch = t1.patch JOIN t2 ON v.team = t2.team AND v.league = t2.league JOIN fin ON fin.patch = v.patch)
"""


@query("v9_enhanced_features", with_views(_ENH + f"SELECT row_id, {_round(ENH)} FROM en", "fx_wide"))
def v9(spark, sf):
    w = _landed(spark, sf)
    return _out(FeatureModel.fit(w).enhanced(w, "rows"), ENH)


_DRAFT_ROWS = """SELECT gameid * 2 + CASE WHEN side = 'Red' THEN 1 ELSE 0 END AS row_id, match_date, year, patch, b_league AS league, b_split AS split_name, CASE WHEN side = 'Blue' AND gameid % 34 = 0 THEN 'Nowhere' ELSE team END AS team, side, result, playoffs,
 top_champion, jng_champion, CASE WHEN side = 'Red' AND gameid % 26 = 0 THEN 'Unknown' ELSE mid_champion END AS mid_champion, bot_champion, sup_champion, ban1, ban2, ban3, ban4, CASE WHEN side = 'Blue' AND gameid % 22 = 0 THEN 'NoBan' ELSE ban5 END AS ban5
 FROM (SELECT *, FIRST_VALUE(league) OVER (PARTITION BY gameid ORDER BY row_id) AS b_league, FIRST_VALUE(split_name) OVER (PARTITION BY gameid ORDER BY row_id) AS b_split FROM fx_wide)"""


def _train(spark, sf):
    w = _landed(spark, sf)
    return FeatureModel.fit(w.filter("year < 1998")), w


@query("v10_draft_vectors", with_views(vector_sql(TRAIN, _DRAFT_ROWS, "snapshot") + f"SELECT row_id, {_round(CANONICAL_48)} FROM vec", "fx_wide"))
def v10(spark, sf):
    from boutline.operators.drafts import side_rows

    model, _ = _train(spark, sf)
    return _out(model.vector(side_rows(fx.drafts(spark, sf)), "snapshot"), CANONICAL_48)


@query("v11_fit_transform", _v(CANONICAL_48, (TRAIN, "SELECT * FROM fx_wide WHERE year >= 1998", "snapshot")))
def v11(spark, sf):
    model, w = _train(spark, sf)
    return _out(model.vector(w.filter("year >= 1998"), "snapshot"), CANONICAL_48)


@query(
    "v11_scaled",
    with_views(
        vector_sql(TRAIN, "SELECT * FROM fx_wide WHERE year < 1998", "rows") + "SELECT row_id, "
        + ", ".join(f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 5) AS {c}" for c in ("team_avg_winrate", "team_meta_strength", "team_recent_winrate", "team_lane_advantage")) + " FROM vec",
        "fx_wide",
    ),
)
def v11s(spark, sf):
    w = _landed(spark, sf).filter("year < 1998")
    cols = ["team_avg_winrate", "team_meta_strength", "team_recent_winrate", "team_lane_advantage"]
    m = FeatureModel.fit(w)
    d = m.lanes(m.past(m.meta(m.composition(w)), "rows")).select("row_id", *cols)
    return features.scale_apply(d, features.scale_fit(d, cols), cols).select("row_id", *[F.round(c, 5).alias(c) for c in cols])


CLASSES = {"tank": [f"C{i}" for i in range(0, 20)], "mage": [f"C{i}" for i in range(20, 40)], "marksman": [f"C{i}" for i in range(40, 60)]}


def _class_sql():
    cl = ", ".join(f"LEN(list_intersect([{', '.join(_CHAMP)}], [{', '.join(repr(c) for c in cs)}])) AS {n}_count" for n, cs in CLASSES.items())
    return f""", s AS (SELECT row_id, CAST(split_part(patch, '.', 1) AS INT) AS patch_major, CAST(split_part(patch, '.', 2) AS INT) AS patch_minor, {cl} FROM fx_wide)
SELECT row_id, patch_major, patch_minor, CAST(tank_count AS INT) AS tank_count, CAST(mage_count AS INT) AS mage_count, CAST(marksman_count AS INT) AS marksman_count,
 CAST(GREATEST(tank_count, mage_count, marksman_count) - LEAST(tank_count, mage_count, marksman_count) AS INT) AS class_balance FROM s"""


@query("v12_static_features", with_views(_class_sql(), "fx_wide"))
def v12(spark, sf):
    return features.static_features(fx.wide(spark, sf), CLASSES)


@query(
    "v12_indicators",
    with_views(
        "SELECT indicator, COUNT(*) AS rows FROM (SELECT DISTINCT row_id, UNNEST([" + ", ".join(f"'{p}_' || {p}_champion" for p in ROLE_PREFIX) + ", " + ", ".join(f"'ban_' || ban{i}" for i in range(1, 6)) + ", 'league_' || league]) AS indicator FROM fx_wide) GROUP BY indicator",
        "fx_wide",
    ),
)
def v12i(spark, sf):
    return features.indicator_pairs(fx.wide(spark, sf)).groupBy("indicator").agg(F.count("*").alias("rows"))


@query("v12_one_hot", with_views(" UNION ALL ".join(f"SELECT row_id, '{c}' AS column_name, {c} AS category FROM fx_wide" for c in [*_CHAMP, "league"]), "fx_wide"))
def v12o(spark, sf):
    """The categories that a row's indicators stand for, decoded from their places."""
    from pyspark.ml.functions import vector_to_array

    w = fx.wide(spark, sf)
    columns = [*_CHAMP, "league"]
    m = features.one_hot(w, columns)
    # names of the places: the labels of each column, then one for values unseen
    places = [(c, v) for c, labels in zip(columns, m.stages[0].labelsArray) for v in [*labels, None]]
    names = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(v).cast("string").alias("category")) for c, v in places])
    on = F.transform(vector_to_array("indicators"), lambda x, i: F.when(x == 1.0, i))
    d = m.transform(w).select("row_id", F.explode(F.filter(on, lambda i: i.isNotNull())).alias("i"))
    return d.select("row_id", F.get(names, F.col("i")).alias("x")).select("row_id", "x.column_name", "x.category")


@query(
    "v13_balanced_subset",
    with_views(
        """, k AS (SELECT row_id, match_date, CASE WHEN row_id % 3 <> 0 THEN patch END AS p FROM fx_wide)
SELECT row_id, COALESCE(p, CASE WHEN na IS NULL OR match_date - nbd <= nad - match_date THEN nb ELSE na END) AS patch FROM (SELECT *,
 LAST_VALUE(p IGNORE NULLS) OVER w1 AS nb, LAST_VALUE(CASE WHEN p IS NOT NULL THEN match_date END IGNORE NULLS) OVER w1 AS nbd, FIRST_VALUE(p IGNORE NULLS) OVER w2 AS na, FIRST_VALUE(CASE WHEN p IS NOT NULL THEN match_date END IGNORE NULLS) OVER w2 AS nad
 FROM k WINDOW w1 AS (ORDER BY match_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (ORDER BY match_date, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
        "fx_wide",
    ),
)
def v13(spark, sf):
    from boutline.operators.quality import nearest_in_time

    w = fx.wide(spark, sf).withColumn("patch", F.when(F.col("row_id") % 3 != 0, F.col("patch")))
    d = features.balanced_subset(nearest_in_time(w.select("row_id", "match_date", "patch", "result"), "patch"), ["^patch$"], ["row_id"])
    return d


_FORM = ("overall_winrate", "recent_winrate", "form_trend", "performance_volatility", "patch_experience", "current_streak")


_CATS = ", ".join(f"('{n}', '{p}')" for n, p in features.CATEGORIES.items())


@query(
    "v14_feature_categories",
    with_views(
        _ENH + ", lgv AS (SELECT feature, COUNT(value) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {'en' if c in ENH else 'vec'}" for c in [*CANONICAL_48, *ENH])
        + f") GROUP BY feature), ct(category, pattern) AS (VALUES {_CATS}) SELECT category, COUNT(*) AS features, CAST(SUM(n) AS BIGINT) AS present FROM lgv JOIN ct ON regexp_matches(feature, pattern) GROUP BY category",
        "fx_wide",
    ),
)
def v14(spark, sf):
    """Features and present values per category, of the 48 and the enhanced ones."""
    from boutline.evaluation.drift import features_long

    w = _landed(spark, sf)
    names = list(dict.fromkeys([*CANONICAL_48, *ENH]))
    d = FeatureModel.fit(w).enhanced(w, "rows")
    n = features_long(d, names, []).groupBy("feature").agg(F.count("*").alias("n"))
    c = features.feature_categories(n, names)
    return n.join(F.broadcast(c), "feature").groupBy("category").agg(F.count("*").alias("features"), F.sum("n").alias("present"))


@query(
    "by_size_subsets",
    with_views(
        "SELECT size, COUNT(*) AS rows FROM (SELECT CAST('0x' || substr(md5('lc-' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS f FROM fx_matches), (SELECT UNNEST([1e-1, 3e-1, 6e-1, 1e0]) AS size) WHERE f < size GROUP BY size",
        "fx_matches",
    ),
)
def sizes(spark, sf):
    return splits.by_size(fx.matches(spark, sf), [0.1, 0.3, 0.6, 1.0]).groupBy("size").agg(F.count("*").alias("rows"))
