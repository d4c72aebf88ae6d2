"""Queries over keyed statistics and matchups."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import day, query, r6
from boutline.catalog.form import _LONG
from boutline.fixtures import with_views
from boutline.operators import encoding, lookups
from boutline.plans.bounded import bounded
from boutline.roles import ROLE_PREFIX
from boutline.session import cut_lineage

_L = """, lng AS (SELECT row_id, gameid, side, patch, team, result, UNNEST([{'r': 'top', 'l': 'Top', 'c': top_champion}, {'r': 'jungle', 'l': 'Jungle', 'c': jng_champion},
 {'r': 'mid', 'l': 'Mid', 'c': mid_champion}, {'r': 'bot', 'l': 'ADC', 'c': bot_champion}, {'r': 'support', 'l': 'Support', 'c': sup_champion}]) AS x FROM fx_wide),
lg AS (SELECT row_id, gameid, side, patch, team, result, x.r AS role, x.l AS label, x.c AS champion FROM lng),
kn AS (SELECT * FROM lg WHERE champion <> 'Unknown'),
bl AS (SELECT row_id, patch, team, p - 1 AS pos, b AS champion FROM (SELECT row_id, patch, team, UNNEST([ban1, ban2, ban3, ban4, ban5]) AS b, UNNEST([1, 2, 3, 4, 5]) AS p FROM fx_wide) WHERE b <> 'NoBan'),
chars AS (SELECT champion, COUNT(*) AS games, CAST(SUM(result) AS BIGINT) AS wins, AVG(CAST(result AS DOUBLE)) AS win_rate, COUNT(DISTINCT label) AS flexibility, MAX(label) AS primary_position FROM kn GROUP BY champion HAVING COUNT(*) >= 5),
arch AS (SELECT champion, CASE WHEN flexibility >= 3 THEN 'FlexPick' ELSE 'Balanced' END AS archetype FROM chars),
rp AS (SELECT role, patch, champion, COUNT(*) AS g, SUM(result) AS w FROM kn GROUP BY 1, 2, 3),
co AS (SELECT a.role, a.champion, b.champion AS opponent, CAST(SUM(a.g) AS BIGINT) AS games, CAST(SUM(a.w) AS BIGINT) AS wins FROM rp a JOIN rp b ON a.role = b.role AND a.patch = b.patch AND a.champion <> b.champion GROUP BY 1, 2, 3 HAVING SUM(a.g) >= 3),
ar AS (SELECT role, COALESCE(archetype, 'Unknown') AS archetype, COUNT(*) AS games, CAST(SUM(result) AS BIGINT) AS wins FROM kn LEFT JOIN arch ON kn.champion = arch.champion GROUP BY 1, 2 HAVING COUNT(*) >= 5),
am AS (SELECT role, ar.archetype, o.archetype AS other, games, wins, wins / CAST(games AS DOUBLE) AS advantage FROM ar JOIN (SELECT DISTINCT archetype FROM arch) o ON ar.archetype <> o.archetype)
"""


def _q(sql):
    return with_views(_L + sql, "fx_wide")


@query("d2_champion_characteristics", _q("SELECT champion, games, wins, ROUND(win_rate, 6) AS win_rate, flexibility, primary_position FROM chars"))
def d2(spark, sf):
    d = lookups.champion_characteristics(fx.wide(spark, sf))
    return d.select("champion", "games", "wins", r6("win_rate"), F.col("flexibility").cast("long").alias("flexibility"), "primary_position")


_META = """, pk AS (SELECT patch, champion, COUNT(*) AS games, CAST(SUM(result) AS BIGINT) AS wins FROM kn GROUP BY 1, 2),
bn AS (SELECT patch, champion, COUNT(*) AS bans FROM bl GROUP BY 1, 2), tg AS (SELECT patch, COUNT(*) AS t FROM fx_wide GROUP BY 1),
meta AS (SELECT patch, champion, games, wins, COALESCE(bans, 0) AS bans, t AS total_games, wins / CAST(games AS DOUBLE) AS win_rate,
  games / (t * 2e0) AS pick_rate, COALESCE(bans, 0) / (t * 2e0) AS ban_rate, games / (t * 2e0) + COALESCE(bans, 0) / (t * 2e0) AS popularity,
  wins / CAST(games AS DOUBLE) * 7e-1 + LEAST(games / (t * 2e0) + COALESCE(bans, 0) / (t * 2e0), 5e-1) * 3e-1 AS meta_strength
  FROM pk LEFT JOIN bn USING (patch, champion) LEFT JOIN tg USING (patch))
"""


@query(
    "d3_meta_indicators",
    _q(_META + "SELECT patch, champion, games, wins, bans, total_games, ROUND(win_rate, 6) AS win_rate, ROUND(pick_rate, 6) AS pick_rate, ROUND(ban_rate, 6) AS ban_rate, ROUND(popularity, 6) AS popularity, ROUND(meta_strength, 6) AS meta_strength FROM meta"),
)
def d3(spark, sf):
    d = lookups.meta_indicators(fx.wide(spark, sf))
    return d.select("patch", "champion", "games", "wins", F.col("bans").cast("long").alias("bans"), "total_games", *[r6(c) for c in ("win_rate", "pick_rate", "ban_rate", "popularity", "meta_strength")])


@query("d4_meta_strength", _q(_META + "SELECT champion, ROUND(AVG(CAST(wins AS DOUBLE) / games * 7e-1 + LEAST(popularity, 5e-1) * 3e-1), 6) AS mean_meta_strength FROM meta GROUP BY champion"))
def d4(spark, sf):
    d = lookups.meta_indicators(fx.wide(spark, sf))
    from boutline.functions.scalar import meta_strength

    return d.groupBy("champion").agg(F.avg(meta_strength(F.col("win_rate"), F.col("popularity"))).alias("m")).select("champion", r6("m", "mean_meta_strength"))


@query("j3_pick_ban_patch_merge", _q(_META + "SELECT patch, CAST(SUM(games) AS BIGINT) AS picks, CAST(SUM(bans) AS BIGINT) AS bans, CAST(MAX(total_games) AS BIGINT) AS total_games FROM meta GROUP BY patch"))
def j3(spark, sf):
    d = lookups.meta_indicators(fx.wide(spark, sf))
    return d.groupBy("patch").agg(F.sum("games").alias("picks"), F.sum("bans").cast("long").alias("bans"), F.max("total_games").alias("total_games"))


@query("d5_ban_priority", _q("SELECT champion, COUNT(*) AS total_bans, COUNT(*) FILTER (WHERE pos < 2) AS early_bans FROM bl GROUP BY champion"))
def d5(spark, sf):
    return lookups.ban_priority(fx.wide(spark, sf)).select("champion", "total_bans", "early_bans")


@query("d5_ban_targets", _q("SELECT team, champion, COUNT(*) AS bans FROM bl GROUP BY team, champion"))
def d5t(spark, sf):
    return lookups.ban_targets(fx.wide(spark, sf))


@query(
    "d6_composition_rates",
    _q(""", s AS (SELECT row_id, result, COUNT(*) AS k, STRING_AGG(champion, '|' ORDER BY champion) AS signature FROM kn GROUP BY 1, 2)
SELECT signature, COUNT(*) AS games, CAST(SUM(result) AS BIGINT) AS wins, ROUND(AVG(CAST(result AS DOUBLE)), 6) AS win_rate FROM s WHERE k >= 3 GROUP BY signature HAVING COUNT(*) >= 2"""),
)
def d6(spark, sf):
    return lookups.composition_rates(fx.wide(spark, sf)).select("signature", "games", "wins", r6("win_rate"))


@query(
    "j1_role_matchups",
    _q("""SELECT a.role, a.champion, b.champion AS opponent, COUNT(*) AS games, CAST(SUM(a.result) AS BIGINT) AS wins, ROUND(AVG(CAST(a.result AS DOUBLE)), 6) AS win_rate
FROM kn a JOIN kn b ON a.gameid = b.gameid AND a.role = b.role AND a.side <> b.side AND a.champion <> b.champion GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3"""),
)
def j1(spark, sf):
    return lookups.role_matchups(fx.wide(spark, sf)).select("role", "champion", "opponent", "games", "wins", r6("win_rate"))


@query(
    "j2_game_pairs",
    with_views(
        """SELECT b.gameid, b.team AS blue_team, r.team AS red_team, b.result AS blue_result, b.top_champion AS blue_top_champion, r.top_champion AS red_top_champion, b.ban1 AS blue_ban1, r.ban1 AS red_ban1
FROM fx_wide b JOIN fx_wide r ON b.gameid = r.gameid AND b.side = 'Blue' AND r.side = 'Red'""",
        "fx_wide",
    ),
)
def j2(spark, sf):
    d = lookups.game_pairs(fx.wide(spark, sf), ["team", "result", "top_champion", "ban1"])
    return d.select("gameid", "blue_team", "red_team", "blue_result", "blue_top_champion", "red_top_champion", "blue_ban1", "red_ban1")


@query("j5_cooccurrence", _q("SELECT role, champion, opponent, games, wins, ROUND(wins / CAST(games AS DOUBLE), 6) AS advantage, ROUND(LEAST(games / 10e0, 1e0), 6) AS confidence FROM co"))
def j5(spark, sf):
    return lookups.cooccurrence_matchups(fx.wide(spark, sf)).select("role", "champion", "opponent", "games", "wins", r6("advantage"), r6("confidence"))


# Every fixture champion plays all roles, so the queries take the scaling from the
# win rate; the classification rule is the same.
_ARCH2 = """, arch2 AS (SELECT champion, CASE WHEN (win_rate - 5e-1) * 1e1 > 3e-1 THEN CASE WHEN win_rate < 3e-1 THEN 'HyperScaling' ELSE 'BalancedScaling' END
 WHEN (win_rate - 5e-1) * 1e1 < -3e-1 THEN 'EarlyGame' WHEN flexibility >= 3 THEN 'FlexPick' ELSE 'Balanced' END AS archetype FROM chars),
ar2 AS (SELECT role, COALESCE(archetype, 'Unknown') AS archetype, COUNT(*) AS games, CAST(SUM(result) AS BIGINT) AS wins FROM kn LEFT JOIN arch2 ON kn.champion = arch2.champion GROUP BY 1, 2 HAVING COUNT(*) >= 5)
"""


def _archetypes(d):
    c = lookups.champion_characteristics(d)
    return c.select("champion", lookups.archetype(F.col("win_rate"), (F.col("win_rate") - 0.5) * 10, F.col("flexibility")).alias("archetype"))


@query(
    "j6_archetype_matchups",
    _q(_ARCH2 + "SELECT role, ar2.archetype, o.archetype AS other, games, wins, ROUND(wins / CAST(games AS DOUBLE), 6) AS advantage FROM ar2 JOIN (SELECT DISTINCT archetype FROM arch2) o ON ar2.archetype <> o.archetype"),
)
def j6(spark, sf):
    d = fx.wide(spark, sf)
    arch = _archetypes(d)
    return lookups.archetype_matchups(d, arch).select("role", "archetype", "other", "games", "wins", r6("advantage"))


@query("d8_archetypes", _q(_ARCH2 + "SELECT champion, archetype FROM arch2"))
def d8(spark, sf):
    return _archetypes(fx.wide(spark, sf))


_PEER = """, tl AS (SELECT team, league, COUNT(*) AS g, SUM(result) AS w FROM fx_matches GROUP BY 1, 2),
pc AS (SELECT a.team, b.team AS peer, CAST(SUM(a.g) AS BIGINT) AS games, CAST(SUM(a.w) AS BIGINT) AS wins FROM tl a JOIN tl b ON a.league = b.league AND a.team <> b.team GROUP BY 1, 2 HAVING SUM(a.g) >= 3)
"""


@query("j7_peer_cross", with_views(_PEER + "SELECT team, peer, games, wins, ROUND(wins / CAST(games AS DOUBLE), 6) AS win_rate FROM pc", "fx_matches"))
def j7(spark, sf):
    return lookups.peer_cross(fx.matches(spark, sf)).select("team", "peer", "games", "wins", r6("win_rate"))


@query(
    "j7b_head_to_head",
    with_views(
        """SELECT a.team, b.team AS opponent, COUNT(*) AS games, CAST(SUM(a.result) AS BIGINT) AS wins, ROUND(AVG(CAST(a.result AS DOUBLE)), 6) AS win_rate
FROM fx_matches a JOIN fx_matches b ON a.gameid = b.gameid AND a.side <> b.side AND a.team <> b.team GROUP BY 1, 2""",
        "fx_matches",
    ),
)
def j7b(spark, sf):
    return lookups.head_to_head(fx.matches(spark, sf)).select("team", "opponent", "games", "wins", r6("win_rate"))


_LANE = """, ln AS (SELECT role, champion, AVG(wins / CAST(games AS DOUBLE)) AS a, AVG(LEAST(games / 10e0, 1e0)) AS c FROM co GROUP BY 1, 2),
aa AS (SELECT role, archetype, AVG(advantage) AS x FROM am GROUP BY 1, 2),
lane AS (SELECT n.role, n.champion, COALESCE(a, 5e-1) AS lane_advantage, COALESCE(c, 1e-1) AS lane_confidence, COALESCE(x, 5e-1) AS archetype_advantage
 FROM (SELECT DISTINCT role, champion FROM kn) n LEFT JOIN ln USING (role, champion) LEFT JOIN arch ON n.champion = arch.champion
 LEFT JOIN aa ON aa.role = n.role AND aa.archetype = COALESCE(arch.archetype, 'Balanced'))
"""


@query("d7_lane_summary", _q(_LANE + "SELECT role, champion, ROUND(lane_advantage, 6) AS lane_advantage, ROUND(lane_confidence, 6) AS lane_confidence, ROUND(archetype_advantage, 6) AS archetype_advantage FROM lane"))
def d7(spark, sf):
    return lookups.lane_summary(cut_lineage(fx.wide(spark, sf))).select("role", "champion", r6("lane_advantage"), r6("lane_confidence"), r6("archetype_advantage"))


_PEERSUM = _PEER + """, ps AS (SELECT t.team, COALESCE(AVG(wins / CAST(games AS DOUBLE)), 5e-1) AS adv, 1e0 - COALESCE(STDDEV_POP(wins / CAST(games AS DOUBLE)), 0e0) AS cons,
 COUNT(*) FILTER (WHERE wins / CAST(games AS DOUBLE) > 6e-1) AS fav, COUNT(*) FILTER (WHERE wins / CAST(games AS DOUBLE) < 4e-1) AS unf
 FROM (SELECT DISTINCT team FROM fx_matches) t LEFT JOIN pc ON t.team = pc.team GROUP BY t.team)
"""


@query("d9_peer_summary", with_views(_PEERSUM + "SELECT team, ROUND(adv, 6) AS team_historical_advantage, ROUND(cons, 6) AS team_matchup_consistency, fav AS favorable_matchups, unf AS unfavorable_matchups FROM ps", "fx_matches"))
def d9(spark, sf):
    d = lookups.peer_summary(fx.matches(spark, sf))
    return d.select("team", r6("team_historical_advantage"), r6("team_matchup_consistency"), "favorable_matchups", "unfavorable_matchups")


_SIDE = """, sd AS (SELECT team, COALESCE(AVG(CASE WHEN side = 'Blue' THEN CAST(result AS DOUBLE) END), 5e-1) AS b, COALESCE(AVG(CASE WHEN side = 'Red' THEN CAST(result AS DOUBLE) END), 5e-1) AS r FROM fx_matches GROUP BY team)
"""


@query(
    "d10_side_rates",
    with_views(_SIDE + "SELECT row_id, ROUND(b, 6) AS blue_side_winrate, ROUND(r, 6) AS red_side_winrate, ROUND(b - r, 6) AS side_preference, ROUND(CASE WHEN side = 'Blue' THEN b ELSE r END, 6) AS current_side_advantage FROM fx_matches JOIN sd USING (team)", "fx_matches"),
)
def d10(spark, sf):
    m = fx.matches(spark, sf)
    d = m.join(bounded(lookups.side_rates(m)), "team")
    cur = F.when(F.col("side") == "Blue", F.col("blue_side_winrate")).otherwise(F.col("red_side_winrate"))
    return d.select("row_id", r6("blue_side_winrate"), r6("red_side_winrate"), r6("side_preference"), r6(cur, "current_side_advantage"))


_OVER = ", ov AS (SELECT team, AVG(CAST(result AS DOUBLE)) AS o, COUNT(DISTINCT league) AS nl FROM fx_matches GROUP BY team)"


@query(
    "d11_team_patch_rate",
    with_views(_OVER + " SELECT team, patch, COUNT(*) AS patch_games, ROUND(AVG(CAST(result AS DOUBLE)), 6) AS patch_win_rate, ROUND(AVG(CAST(result AS DOUBLE)) - MAX(o), 6) AS patch_adaptation_rate FROM fx_matches JOIN ov USING (team) GROUP BY team, patch", "fx_matches"),
)
def d11(spark, sf):
    return lookups.patch_rates(fx.matches(spark, sf)).select("team", "patch", "patch_games", r6("patch_win_rate"), r6("patch_adaptation_rate"))


@query(
    "d12_team_league_rate",
    with_views(_OVER + " SELECT team, league, ROUND(AVG(CAST(result AS DOUBLE)), 6) AS league_specific_winrate, ROUND(AVG(CAST(result AS DOUBLE)) - MAX(o), 6) AS league_dominance, ROUND(LEAST(MAX(nl) / 5e0, 1e0), 6) AS cross_league_experience FROM fx_matches JOIN ov USING (team) GROUP BY team, league", "fx_matches"),
)
def d12(spark, sf):
    return lookups.league_rates(fx.matches(spark, sf)).select("team", "league", r6("league_specific_winrate"), r6("league_dominance"), r6("cross_league_experience"))


@query(
    "d13_leave_one_out",
    with_views(
        """SELECT row_id, ROUND(CASE WHEN COUNT(*) OVER (PARTITION BY team) > 1 THEN (SUM(result) OVER (PARTITION BY team) - result) / CAST(COUNT(*) OVER (PARTITION BY team) - 1 AS DOUBLE)
  ELSE AVG(CAST(result AS DOUBLE)) OVER () END, 6) AS team_loo_encoded FROM fx_matches""",
        "fx_matches",
    ),
)
def d13(spark, sf):
    return encoding.leave_one_out(fx.matches(spark, sf), "team").select("row_id", r6("team_loo_encoded"))


ENC_COLS = ["league", "team", "patch", "split_name", *[f"{p}_champion" for p in ROLE_PREFIX], *[f"{p}_player" for p in ROLE_PREFIX]]
_ENC = ", el AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS category, result FROM fx_wide" for c in ENC_COLS) + """),
gm AS (SELECT AVG(CAST(result AS DOUBLE)) AS gm FROM fx_wide),
ec AS (SELECT column_name, category, COUNT(*) AS n, AVG(CAST(result AS DOUBLE)) AS m FROM el GROUP BY 1, 2),
enc AS (SELECT column_name, category, n, gm, n * gm * (1e0 - gm) / (m * (1e0 - m) + n * gm * (1e0 - gm)) AS lam, m FROM ec, gm)
"""


@query("d14_target_encoding", with_views(_ENC + "SELECT column_name, category, n, ROUND(lam * m + (1e0 - lam) * gm, 6) AS encoded FROM enc", "fx_wide"))
def d14(spark, sf):
    return encoding.fit_target_encoding(fx.wide(spark, sf), ENC_COLS).select("column_name", "category", "n", r6("encoded"))


@query("d14_smoothed_encoding", with_views(_ENC + "SELECT column_name, category, n, ROUND((n * m + 1e1 * gm) / (n + 1e1), 6) AS encoded FROM enc", "fx_wide"))
def d14s(spark, sf):
    return encoding.fit_target_encoding(fx.wide(spark, sf), ENC_COLS, smoothing=10.0).select("column_name", "category", "n", r6("encoded"))


_APPLY = ["league", "team", "patch", "top_champion"]
_FIT = """, tr AS (SELECT * FROM fx_wide WHERE year < 1998), el AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS category, result FROM tr" for c in _APPLY) + """),
gm AS (SELECT AVG(CAST(result AS DOUBLE)) AS gm FROM tr), ec AS (SELECT column_name, category, COUNT(*) AS n, AVG(CAST(result AS DOUBLE)) AS m FROM el GROUP BY 1, 2),
enc AS (SELECT column_name, category, n * gm * (1e0 - gm) / (m * (1e0 - m) + n * gm * (1e0 - gm)) * m + (1e0 - n * gm * (1e0 - gm) / (m * (1e0 - m) + n * gm * (1e0 - gm))) * gm AS e FROM ec, gm)
SELECT row_id, """ + ", ".join(f"ROUND(COALESCE(e_{c}.e, (SELECT gm FROM gm)), 6) AS {c}_target_encoded" for c in _APPLY) + " FROM fx_wide w " + " ".join(
    f"LEFT JOIN enc e_{c} ON e_{c}.column_name = '{c}' AND e_{c}.category = CAST(w.{c} AS VARCHAR)" for c in _APPLY
) + " WHERE w.year >= 1998"


@query("d14_encoding_applied", with_views(_FIT, "fx_wide"))
def d14a(spark, sf):
    """Fitted on earlier years, applied to later ones, whose patches are all unseen."""
    w = fx.wide(spark, sf)
    fitted = encoding.fit_target_encoding(w.filter("year < 1998"), _APPLY)
    d = encoding.apply_target_encoding(w.filter("year >= 1998"), fitted, _APPLY)
    return d.select("row_id", *[r6(f"{c}_target_encoded") for c in _APPLY])


@query(
    "d14_out_of_fold",
    with_views(
        """, f AS (SELECT row_id, team, result, CAST(CAST('0x' || substr(md5('te-' || CAST(row_id AS VARCHAR)), 1, 6) AS BIGINT) % 5 AS INT) AS fold FROM fx_matches),
c AS (SELECT team, fold, COUNT(*) AS n, SUM(result) AS s FROM f GROUP BY 1, 2), t AS (SELECT team, SUM(n) AS n, SUM(s) AS s FROM c GROUP BY 1),
g AS (SELECT fold, SUM(n) AS n, SUM(s) AS s FROM c GROUP BY 1), a AS (SELECT SUM(n) AS n, SUM(s) AS s FROM c),
z AS (SELECT c.team, c.fold, CAST(t.n - c.n AS DOUBLE) AS n, (t.s - c.s) / CAST(t.n - c.n AS DOUBLE) AS m, (a.s - g.s) / CAST(a.n - g.n AS DOUBLE) AS gm FROM c JOIN t ON c.team = t.team JOIN g ON c.fold = g.fold, a)
SELECT row_id, f.fold, ROUND(CASE WHEN n > 0 THEN (n * gm * (1e0 - gm) * m + m * (1e0 - m) * gm) / (m * (1e0 - m) + n * gm * (1e0 - gm)) ELSE gm END, 6) AS team_oof_encoded FROM f JOIN z ON f.team = z.team AND f.fold = z.fold""",
        "fx_matches",
    ),
)
def d14o(spark, sf):
    return encoding.out_of_fold_encoding(fx.matches(spark, sf), "team").select("row_id", "fold", r6("team_oof_encoded"))


@query("d16_popular_champions", _q("""SELECT patch, champion, picks, place FROM (SELECT patch, champion, COUNT(*) AS picks, ROW_NUMBER() OVER (PARTITION BY patch ORDER BY COUNT(*) DESC, champion) AS place FROM kn GROUP BY 1, 2) WHERE place <= 10"""))
def d16(spark, sf):
    d = lookups.popular_champions(fx.wide(spark, sf))
    return d.select("patch", "champion", "picks", F.col("place").cast("long").alias("place"))


@query(
    "d17_league_statistics",
    with_views("""SELECT league, COUNT(*) AS rows, COUNT(DISTINCT gameid) AS games, COUNT(DISTINCT team) AS teams, COUNT(DISTINCT patch) AS patches,
  strftime(MIN(match_date), '%Y-%m-%d') AS first_date, strftime(MAX(match_date), '%Y-%m-%d') AS last_date, ROUND(AVG(CAST(result AS DOUBLE)), 6) AS win_rate FROM fx_matches GROUP BY league""", "fx_matches"),
)
def d17(spark, sf):
    d = lookups.dataset_statistics(fx.matches(spark, sf), ["league"])
    return d.select("league", "rows", "games", "teams", "patches", day("first_date"), day("last_date"), r6("win_rate"))


@query(
    "d23_fallback_rates",
    _q("""SELECT 'role' AS kind, role AS name, ROUND(COALESCE(AVG(CASE WHEN n >= 10 THEN m END), 5e-1), 6) AS value FROM (SELECT role, champion, COUNT(*) AS n, AVG(CAST(result AS DOUBLE)) AS m FROM lg GROUP BY 1, 2) GROUP BY role
UNION ALL SELECT 'league', league, ROUND(AVG(CAST(result AS DOUBLE)), 6) FROM fx_wide GROUP BY league UNION ALL SELECT 'global', 'all', ROUND(AVG(CAST(result AS DOUBLE)), 6) FROM fx_wide"""),
)
def d23(spark, sf):
    return lookups.fallback_rates(fx.wide(spark, sf)).select("kind", "name", r6("value"))


@query(
    "d26_team_tiers",
    with_views("""SELECT team, ROUND(w, 6) AS win_rate, CASE WHEN w <= 0 THEN NULL WHEN w <= 3e-1 THEN 'Low' WHEN w <= 45e-2 THEN 'Below_Avg' WHEN w <= 55e-2 THEN 'Average' WHEN w <= 7e-1 THEN 'Above_Avg' ELSE 'High' END AS tier
FROM (SELECT team, AVG(CAST(result AS DOUBLE)) AS w FROM fx_matches GROUP BY team)""", "fx_matches"),
)
def d26(spark, sf):
    return lookups.team_tiers(fx.matches(spark, sf)).select("team", r6("win_rate"), "tier")


@query(
    "d27_known_summary",
    _q("""SELECT (SELECT COUNT(DISTINCT champion) FROM lg) AS known_champions, (SELECT COUNT(DISTINCT team) FROM fx_wide) AS known_teams, (SELECT COUNT(DISTINCT patch) FROM fx_wide) AS known_patches,
(SELECT COUNT(*) FROM (SELECT team FROM fx_wide GROUP BY 1 HAVING COUNT(*) >= 10)) AS reliable_teams, (SELECT COUNT(*) FROM (SELECT champion FROM lg GROUP BY 1 HAVING COUNT(*) >= 20)) AS reliable_champions"""),
)
def d27(spark, sf):
    return lookups.known_summary(fx.wide(spark, sf))


@query(
    "j4_lookup_default",
    _q("SELECT row_id, ROUND(AVG(COALESCE(c.win_rate, 5e-1)), 6) AS mean_win_rate FROM lg LEFT JOIN chars c ON lg.champion = c.champion AND c.games >= 800 GROUP BY row_id"),
)
def j4(spark, sf):
    from boutline.operators.features import role_lookup
    from boutline.functions.scalar import row_mean

    d = fx.wide(spark, sf)
    # a high bar on games, so that some champions fall to the default
    chars = lookups.champion_characteristics(d, min_games=800)
    out = role_lookup(d, chars.select("champion", "win_rate"), [], {"win_rate": 0.5})
    return out.select("row_id", r6(row_mean([F.col(f"win_rate_{i}") for i in range(5)]), "mean_win_rate"))
