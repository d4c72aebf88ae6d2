"""Queries over histories of entities and players."""

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.fixtures import with_views
from boutline.operators import form
from boutline.session import cut_lineage
from pyspark.sql import functions as F

W = "(PARTITION BY team ORDER BY match_date, row_id"
PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _frame(k):
    return f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING"


@query(
    "w1_prior_record",
    with_views(
        f"""SELECT row_id, COUNT(*) OVER {W} {PREV}) AS games_played,
  CAST(COALESCE(SUM(result) OVER {W} {PREV}), 0) AS BIGINT) AS wins_before,
  ROUND(COALESCE(AVG(CAST(result AS DOUBLE)) OVER {W} {PREV}), 5e-1), 6) AS overall_winrate FROM fx_matches""",
        "fx_matches",
    ),
)
def w1(spark, sf):
    d = form.entity_form(fx.matches(spark, sf))
    return d.select("row_id", "games_played", F.col("wins_before").cast("long").alias("wins_before"), r6("overall_winrate"))


_W2 = f"COALESCE(AVG(CAST(result AS DOUBLE)) OVER {W} {_frame(10)}), 5e-1)"
_W1 = f"COALESCE(AVG(CAST(result AS DOUBLE)) OVER {W} {PREV}), 5e-1)"


@query("w2_recent_rate", with_views(f"SELECT row_id, ROUND({_W2}, 6) AS recent_winrate FROM fx_matches", "fx_matches"))
def w2(spark, sf):
    return form.entity_form(fx.matches(spark, sf)).select("row_id", r6("recent_winrate"))


@query("w3_form_trend", with_views(f"SELECT row_id, ROUND({_W2} - {_W1}, 6) AS form_trend FROM fx_matches", "fx_matches"))
def w3(spark, sf):
    return form.entity_form(fx.matches(spark, sf)).select("row_id", r6("form_trend"))


_LONG = """, lng AS (SELECT row_id, match_date, result, 'top' AS role, top_champion AS champion, top_player AS player FROM fx_wide
 UNION ALL SELECT row_id, match_date, result, 'jungle', jng_champion, jng_player FROM fx_wide
 UNION ALL SELECT row_id, match_date, result, 'mid', mid_champion, mid_player FROM fx_wide
 UNION ALL SELECT row_id, match_date, result, 'bot', bot_champion, bot_player FROM fx_wide
 UNION ALL SELECT row_id, match_date, result, 'support', sup_champion, sup_player FROM fx_wide)
"""
PW = "(PARTITION BY player ORDER BY match_date, row_id"
CW = "(PARTITION BY player, champion ORDER BY match_date, row_id"


@query(
    "w4_player_history",
    with_views(
        _LONG
        + f"""SELECT row_id, role, COUNT(*) OVER {PW} {PREV}) AS player_games,
  ROUND(COALESCE(AVG(CAST(result AS DOUBLE)) OVER {PW} {PREV}), 5e-1), 6) AS player_winrate,
  ROUND(COALESCE(AVG(CAST(result AS DOUBLE)) OVER {PW} {_frame(10)}), 5e-1), 6) AS player_recent FROM lng""",
        "fx_wide",
    ),
)
def w4(spark, sf):
    return form.player_form(fx.wide(spark, sf)).select("row_id", "role", "player_games", r6("player_winrate"), r6("player_recent"))


@query(
    "w5_champion_mastery",
    with_views(
        _LONG
        + f"""SELECT row_id, role, COUNT(*) OVER {CW} {PREV}) AS champion_games,
  ROUND(COALESCE(AVG(CAST(result AS DOUBLE)) OVER {CW} {PREV}), 5e-1), 6) AS champion_mastery FROM lng""",
        "fx_wide",
    ),
)
def w5(spark, sf):
    return form.player_form(fx.wide(spark, sf)).select("row_id", "role", "champion_games", r6("champion_mastery"))


def _avg(k):
    return f"COALESCE(AVG(CAST(result AS DOUBLE)) OVER {W} {_frame(k)}), 5e-1)"


@query(
    "w6_last_3_5_10",
    with_views(
        f"""SELECT row_id, ROUND({_avg(3)}, 6) AS winrate_last_3, ROUND({_avg(5)}, 6) AS winrate_last_5,
  ROUND({_avg(10)}, 6) AS winrate_last_10, ROUND({_avg(3)} - {_avg(10)}, 6) AS form_momentum_short FROM fx_matches""",
        "fx_matches",
    ),
)
def w6(spark, sf):
    d = form.entity_form(fx.matches(spark, sf))
    return d.select("row_id", r6("winrate_last_3"), r6("winrate_last_5"), r6("winrate_last_10"), r6("form_momentum_short"))


@query(
    "w7_volatility",
    with_views(
        f"""SELECT row_id, ROUND(CASE WHEN COUNT(*) OVER {W} {_frame(10)}) >= 3
  THEN STDDEV_SAMP(result) OVER {W} {_frame(10)}) ELSE 5e-1 END, 6) AS performance_volatility FROM fx_matches""",
        "fx_matches",
    ),
)
def w7(spark, sf):
    return form.entity_form(fx.matches(spark, sf)).select("row_id", r6("performance_volatility"))


@query(
    "w8_current_streak",
    with_views(
        f""", a AS (SELECT row_id, team, match_date, result, LAG(result) OVER {W}) AS p FROM fx_matches),
b AS (SELECT *, SUM(CASE WHEN p IS NULL OR p <> result THEN 1 ELSE 0 END) OVER {W}) AS isl FROM a),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, isl ORDER BY match_date, row_id) * CASE WHEN result = 1 THEN 1 ELSE -1 END AS run FROM b)
SELECT row_id, CAST(COALESCE(LAG(run) OVER {W}), 0) AS BIGINT) AS current_streak FROM c""",
        "fx_matches",
    ),
)
def w8(spark, sf):
    return form.entity_form(fx.matches(spark, sf)).select("row_id", "current_streak")


TP = "(PARTITION BY team, patch ORDER BY match_date, row_id"


@query(
    "w9_patch_experience",
    with_views(
        f"""SELECT row_id, COUNT(*) OVER {TP} {PREV}) + 1 AS patch_experience,
  ROUND(COALESCE(AVG(CAST(result AS DOUBLE)) OVER {TP} {PREV}), 5e-1), 6) AS patch_performance FROM fx_matches""",
        "fx_matches",
    ),
)
def w9(spark, sf):
    return form.entity_form(fx.matches(spark, sf)).select("row_id", "patch_experience", r6("patch_performance"))


@query(
    "w10_vs_league",
    with_views(
        f"""SELECT row_id, ROUND(COALESCE(AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY team, league ORDER BY match_date, row_id {_frame(5)}), 5e-1)
  - AVG(CAST(result AS DOUBLE)) OVER (PARTITION BY league), 6) AS vs_league_avg FROM fx_matches""",
        "fx_matches",
    ),
)
def w10(spark, sf):
    return form.versus_league(fx.matches(spark, sf)).select("row_id", r6("vs_league_avg"))


_SHIFT = """, n AS (SELECT patch, COUNT(*) AS rows_n, CAST(split_part(patch, '.', 1) AS INT) * 100 + CAST(split_part(patch, '.', 2) AS INT) AS no FROM fx_wide GROUP BY patch),
sq AS (SELECT patch, rows_n, LAG(patch) OVER (ORDER BY no, patch) AS prev FROM n),
pch AS (SELECT patch, COUNT(DISTINCT c) AS div FROM (SELECT patch, UNNEST([top_champion, jng_champion, mid_champion, bot_champion, sup_champion]) AS c FROM fx_wide) GROUP BY patch),
tm AS (SELECT patch, COALESCE(VAR_SAMP(m), 0e0) AS v, COUNT(*) AS teams FROM (SELECT patch, team, AVG(CAST(result AS DOUBLE)) AS m FROM fx_wide GROUP BY patch, team) GROUP BY patch),
pln AS (SELECT patch, AVG(game_length) AS len FROM fx_wide GROUP BY patch),
st AS (SELECT sq.patch, rows_n, prev, div, v, teams, len FROM sq JOIN pch USING (patch) JOIN tm USING (patch) JOIN pln USING (patch)),
ok AS (SELECT * FROM st WHERE rows_n >= 10),
sh AS (SELECT c.patch, (c.div - p.div) / CAST(p.div AS DOUBLE) AS d, (c.len - p.len) / p.len AS g, ABS(c.v - p.v) AS b FROM ok c JOIN ok p ON c.prev = p.patch),
tc AS (SELECT patch, top_champion AS c, COUNT(*) AS k FROM fx_wide GROUP BY 1, 2),
tps AS (SELECT patch, c, k / CAST(rows_n AS DOUBLE) AS s FROM tc JOIN n USING (patch) WHERE rows_n >= 5),
pr AS (SELECT s.patch, s.prev FROM sq s JOIN n a ON s.patch = a.patch AND a.rows_n >= 5 JOIN n b ON s.prev = b.patch AND b.rows_n >= 5),
un AS (SELECT pr.patch, c FROM pr JOIN tps ON tps.patch = pr.patch UNION SELECT pr.patch, c FROM pr JOIN tps ON tps.patch = pr.prev),
pks AS (SELECT un.patch, AVG(ABS(COALESCE(a.s, 0e0) - COALESCE(b.s, 0e0))) AS m FROM un JOIN pr ON un.patch = pr.patch
  LEFT JOIN tps a ON a.patch = un.patch AND a.c = un.c LEFT JOIN tps b ON b.patch = pr.prev AND b.c = un.c GROUP BY un.patch),
fin AS (SELECT sq.patch, rows_n, COALESCE(d, 0e0) AS d, COALESCE(g, 0e0) AS g, COALESCE(b, 0e0) AS b,
  COALESCE(1e0 - (ABS(d) + ABS(g) + b) / 3e0, 1e0) AS stab, COALESCE(m, 0e0) AS m FROM sq LEFT JOIN sh USING (patch) LEFT JOIN pks USING (patch))
"""


@query(
    "d15_patch_statistics",
    with_views(
        _SHIFT + "SELECT patch, div AS champion_diversity, rows_n AS patch_games, ROUND(len, 6) AS avg_game_length, ROUND(v, 6) AS win_rate_variance, teams AS unique_teams FROM ok",
        "fx_wide",
    ),
)
def d15(spark, sf):
    d = form.patch_statistics(fx.wide(spark, sf))
    return d.select("patch", "champion_diversity", "patch_games", r6("avg_game_length"), r6("win_rate_variance"), "unique_teams")


@query(
    "w12_patch_shift",
    with_views(
        _SHIFT
        + """SELECT patch, rows_n AS patch_games_count, ROUND(d, 6) AS diversity_shift, ROUND(g, 6) AS game_length_shift, ROUND(b, 6) AS balance_shift,
  ROUND(stab, 6) AS patch_stability, ROUND(m, 6) AS pick_shift_magnitude, ROUND(1e0 - stab, 6) AS meta_shift_magnitude FROM fin""",
        "fx_wide",
    ),
)
def w12(spark, sf):
    d = form.patch_shift(cut_lineage(fx.wide(spark, sf)))
    return d.select("patch", "patch_games_count", *[r6(c) for c in d.columns if c not in ("patch", "patch_games_count")])


@query(
    "w11_meta_adaptation",
    with_views(
        _SHIFT
        + f""", x AS (SELECT row_id, team, match_date, CASE WHEN stab < 98e-2 THEN result END AS hr FROM fx_wide JOIN fin USING (patch))
SELECT row_id, ROUND(CASE WHEN COUNT(*) OVER {W} {PREV}) > 5 THEN COALESCE(AVG(CAST(hr AS DOUBLE)) OVER {W} {PREV}), 5e-1) ELSE 5e-1 END, 6) AS team_meta_adaptation FROM x""",
        "fx_wide",
    ),
)
def w11(spark, sf):
    d = cut_lineage(fx.wide(spark, sf))
    # the fixture's patches are calm: 0.98 splits them, the default 0.7 would flag none
    return form.meta_adaptation(d, form.patch_shift(d), unstable=0.98).select("row_id", r6("team_meta_adaptation"))


@query(
    "w13_games_on_patch",
    with_views(
        f""", g AS (SELECT row_id, COUNT(*) OVER {TP} {PREV}) AS n FROM fx_matches)
SELECT row_id, n AS games_on_patch, CASE WHEN n < 3 THEN 1 ELSE 0 END AS early_patch_indicator, ROUND(LEAST(n / 20e0, 1e0), 6) AS games_on_patch_normalized,
  ROUND(LEAST(n / 20e0, 1e0) * CASE WHEN n < 3 THEN 0 ELSE 1 END, 6) AS patch_experience_advantage FROM g""",
        "fx_matches",
    ),
)
def w13(spark, sf):
    d = form.patch_use(fx.matches(spark, sf))
    return d.select("row_id", "games_on_patch", "early_patch_indicator", r6("games_on_patch_normalized"), r6("patch_experience_advantage"))


@query(
    "j15_latest_form",
    with_views(
        """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, row_id DESC) AS k FROM fx_matches),
f AS (SELECT team, MIN(CASE WHEN result <> first_r THEN k END) AS brk, MAX(k) AS n, MAX(first_r) AS fr FROM
  (SELECT *, FIRST_VALUE(result) OVER (PARTITION BY team ORDER BY k) AS first_r FROM r) GROUP BY team)
SELECT r.team, COUNT(*) AS games_played, ROUND(AVG(CAST(result AS DOUBLE)), 6) AS overall_winrate,
  ROUND(AVG(CASE WHEN k <= 10 THEN CAST(result AS DOUBLE) END), 6) AS recent_winrate,
  ROUND(AVG(CASE WHEN k <= 10 THEN CAST(result AS DOUBLE) END) - AVG(CAST(result AS DOUBLE)), 6) AS form_trend,
  CAST(MAX(COALESCE(brk - 1, n) * CASE WHEN fr = 1 THEN 1 ELSE -1 END) AS BIGINT) AS current_streak
FROM r JOIN f ON r.team = f.team GROUP BY r.team""",
        "fx_matches",
    ),
)
def j15(spark, sf):
    d = form.latest_form(fx.matches(spark, sf))
    return d.select("team", "games_played", r6("overall_winrate"), r6("recent_winrate"), r6("form_trend"), "current_streak")


@query(
    "j15_latest_player",
    with_views(
        _LONG
        + """SELECT player, champion, CAST(SUM(COUNT(*)) OVER (PARTITION BY player) AS BIGINT) AS player_games, COUNT(*) AS champion_games,
  ROUND(SUM(SUM(result)) OVER (PARTITION BY player) / CAST(SUM(COUNT(*)) OVER (PARTITION BY player) AS DOUBLE), 6) AS player_winrate,
  ROUND(AVG(CAST(result AS DOUBLE)), 6) AS champion_mastery FROM lng GROUP BY player, champion""",
        "fx_wide",
    ),
)
def j15p(spark, sf):
    d = form.latest_player(fx.wide(spark, sf))
    return d.select("player", "champion", "player_games", "champion_games", r6("player_winrate"), r6("champion_mastery"))
