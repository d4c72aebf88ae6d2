"""Queries over drafts: checks, names, fallbacks, candidates, suggestions."""

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.catalog.lookups import _L, _META
from boutline.fixtures import table, with_views
from boutline.operators import drafts, lookups
from boutline.roles import ROLE_PREFIX, ROLES

_CH = [f"{p}_champion" for p in ROLE_PREFIX]
# The spoiled drafts of the fixture as SQL.
_DR = """, dr AS (SELECT b.gameid AS draft_id, b.patch, CASE WHEN b.gameid % 34 = 0 THEN 'Nowhere' ELSE b.team END AS blue_team, r.team AS red_team,
 [b.top_champion, b.jng_champion, b.mid_champion, b.bot_champion, b.sup_champion] AS bp, CASE WHEN b.gameid % 26 = 0 THEN [r.top_champion, r.jng_champion, r.bot_champion, r.sup_champion] ELSE [r.top_champion, r.jng_champion, r.mid_champion, r.bot_champion, r.sup_champion] END AS rp,
 CASE WHEN b.gameid % 22 = 0 THEN [b.ban1, b.ban2, b.ban3, b.ban4] ELSE [b.ban1, b.ban2, b.ban3, b.ban4, b.ban5] END AS bb, [r.ban1, r.ban2, r.ban3, r.ban4, r.ban5] AS rb
 FROM fx_wide b JOIN fx_wide r ON b.gameid = r.gameid AND b.side = 'Blue' AND r.side = 'Red')
"""


@query(
    "j17_validate_drafts",
    with_views(
        _DR + """, kc AS (SELECT UNNEST(list_distinct([top_champion, jng_champion, mid_champion, bot_champion, sup_champion])) AS c FROM fx_wide), kn AS (SELECT DISTINCT c FROM kc WHERE c <> 'Unknown'),
u AS (SELECT draft_id, 'blue' AS s, UNNEST(list_distinct(list_concat(bp, bb))) AS c FROM dr UNION ALL SELECT draft_id, 'red', UNNEST(list_distinct(list_concat(rp, rb))) FROM dr),
al AS (SELECT draft_id, UNNEST(list_concat(list_concat(bp, rp), list_concat(bb, rb))) AS c FROM dr)
SELECT draft_id, 'blue: unknown team ' || blue_team AS error FROM dr WHERE blue_team = 'Nowhere'
UNION ALL SELECT draft_id, 'red: missing role mid' FROM dr WHERE draft_id % 26 = 0
UNION ALL SELECT draft_id, 'blue: expected 5 bans, got 4' FROM dr WHERE draft_id % 22 = 0
UNION ALL SELECT draft_id, s || ': unknown champion ' || c FROM u WHERE c <> 'NoBan' AND c NOT IN (SELECT c FROM kn)
UNION ALL SELECT draft_id, 'duplicate champion ' || c FROM al WHERE c <> 'NoBan' GROUP BY draft_id, c HAVING COUNT(*) > 1""",
        "fx_wide",
    ),
)
def j17(spark, sf):
    w = fx.wide(spark, sf)
    known = lookups.champion_counts(w).filter("champion <> 'Unknown'")
    return drafts.validate(fx.drafts(spark, sf), known, lookups.team_counts(w))


_TEST = """, tr AS (SELECT * FROM fx_wide WHERE year < 1998), te AS (SELECT row_id, league, CASE WHEN row_id % 17 = 0 THEN 'New Team' ELSE team END AS team, CASE WHEN row_id % 23 = 0 THEN '99.' || CAST(row_id % 7 AS VARCHAR) ELSE patch END AS patch,
 CASE WHEN row_id % 19 = 0 THEN 'C99' ELSE top_champion END AS top_champion, jng_champion, mid_champion, bot_champion, sup_champion FROM fx_wide WHERE year >= 1998),
cc AS (SELECT c, COUNT(*) AS n FROM (SELECT UNNEST([top_champion, jng_champion, mid_champion, bot_champion, sup_champion]) AS c FROM tr) GROUP BY c), tc AS (SELECT team, COUNT(*) AS n FROM tr GROUP BY team), kp AS (SELECT DISTINCT patch FROM tr),
cu AS (SELECT row_id, COUNT(*) FILTER (WHERE cc.n IS NULL) AS newc, COUNT(*) FILTER (WHERE cc.n < 20) AS lowc FROM (SELECT row_id, UNNEST([top_champion, jng_champion, mid_champion, bot_champion, sup_champion]) AS c FROM te) x LEFT JOIN cc ON x.c = cc.c GROUP BY row_id),
fl AS (SELECT te.*, newc, lowc, tc.n IS NULL AS nt, COALESCE(tc.n, 99) < 10 AS lt, te.patch NOT IN (SELECT patch FROM kp) AS np FROM te JOIN cu USING (row_id) LEFT JOIN tc ON te.team = tc.team),
ed AS (SELECT *, CAST(lowc > 0 AS INT) + CAST(lt AS INT) + CAST(newc > 0 AS INT) + CAST(np AS INT) + CAST(nt AS INT) AS k, array_to_string(list_filter([CASE WHEN lowc > 0 THEN 'low_sample_champion' END, CASE WHEN lt THEN 'low_sample_team' END, CASE WHEN newc > 0 THEN 'new_champion' END, CASE WHEN np THEN 'new_patch' END, CASE WHEN nt THEN 'new_team' END], lambda x: x IS NOT NULL), ',') AS edge_cases FROM fl)
"""


def _split(spark, sf):
    w = fx.wide(spark, sf)
    i = F.col("row_id")
    test = w.filter("year >= 1998").withColumns(
        {
            "team": F.when(i % 17 == 0, "New Team").otherwise(F.col("team")),
            "patch": F.when(i % 23 == 0, F.concat(F.lit("99."), (i % 7).cast("string"))).otherwise(F.col("patch")),
            "top_champion": F.when(i % 19 == 0, "C99").otherwise(F.col("top_champion")),
        }
    )
    return drafts.KnownEntities(w.filter("year < 1998")), test


@query(
    "j11_edge_cases",
    with_views(
        _TEST + """SELECT row_id, edge_cases, CAST(newc AS INT) AS new_champions, CAST(lowc AS INT) AS low_sample_champions,
 ROUND(LEAST(CASE WHEN nt THEN 2e-1 WHEN lt THEN 1e-1 ELSE 0e0 END + newc * 15e-2 + lowc * 5e-2 + CASE WHEN np THEN 1e-1 ELSE 0e0 END + CASE WHEN k > 1 THEN 5e-2 ELSE 0e0 END, 5e-1), 6) AS confidence_penalty FROM ed""",
        "fx_wide",
    ),
)
def j11(spark, sf):
    known, test = _split(spark, sf)
    return drafts.edge_cases(test, known).select("row_id", "edge_cases", "new_champions", "low_sample_champions", r6("confidence_penalty"))


_NEAR = """, np AS (SELECT q, ARG_MIN(patch, CAST(d AS BIGINT) * 1000000 + no) AS nearest FROM (SELECT q.patch AS q, kp.patch, 100 * ABS(CAST(split_part(q.patch, '.', 1) AS INT) - CAST(split_part(kp.patch, '.', 1) AS INT)) + ABS(CAST(split_part(q.patch, '.', 2) AS INT) - CAST(split_part(kp.patch, '.', 2) AS INT)) AS d,
 CAST(split_part(kp.patch, '.', 1) AS INT) * 100 + CAST(split_part(kp.patch, '.', 2) AS INT) AS no FROM (SELECT DISTINCT patch FROM te) q, kp) GROUP BY q)
"""


@query("j9_nearest_patch", with_views(_TEST + _NEAR + "SELECT q AS patch, nearest FROM np", "fx_wide"))
def j9(spark, sf):
    known, test = _split(spark, sf)
    return drafts.nearest_patch(test, known.patches)


@query(
    "j12_fallback",
    with_views(
        _TEST + _NEAR + """, rm AS (SELECT COALESCE(AVG(CASE WHEN n >= 10 THEN m END), 5e-1) AS v FROM (SELECT top_champion, COUNT(*) AS n, AVG(CAST(result AS DOUBLE)) AS m FROM tr GROUP BY 1)), lm AS (SELECT league, AVG(CAST(result AS DOUBLE)) AS v FROM tr GROUP BY league)
SELECT row_id, ROUND(CASE WHEN nt THEN lm.v END, 6) AS team_fallback, CASE WHEN np THEN nearest ELSE patch END AS patch_used, ROUND(CASE WHEN top_champion = 'C99' THEN rm.v END, 6) AS top_fallback FROM ed JOIN np ON ed.patch = np.q LEFT JOIN lm ON ed.league = lm.league, rm""",
        "fx_wide",
    ),
)
def j12(spark, sf):
    known, test = _split(spark, sf)
    return drafts.apply_fallback(test, known).select("row_id", r6("team_fallback"), "patch_used", r6("top_fallback"))


@query(
    "j14_swap_candidates",
    with_views(
        _L + _META + _DR + """, ca AS (SELECT draft_id, champion, meta_strength, ROW_NUMBER() OVER (PARTITION BY draft_id ORDER BY meta_strength DESC, champion) AS place FROM dr JOIN meta ON dr.patch = meta.patch WHERE NOT list_contains(list_concat(list_concat(bp, rp), list_concat(bb, rb)), champion))
SELECT draft_id, role, champion, place FROM ca, (SELECT UNNEST(['top', 'jungle', 'mid', 'bot', 'support']) AS role) WHERE place <= 5""",
        "fx_wide",
    ),
)
def j14(spark, sf):
    d = drafts.swap_candidates(fx.drafts(spark, sf), lookups.meta_indicators(fx.wide(spark, sf)))
    return d.select("draft_id", "role", "champion", F.col("place").cast("long").alias("place"))


def _gains(spark, sf):
    d = drafts.swap_candidates(fx.drafts(spark, sf), lookups.meta_indicators(fx.wide(spark, sf)))
    i = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    return d.withColumn("gain", ((F.col("draft_id") * 7 + F.col("place") * 13 + i * 5) % 41 - 5) / F.lit(4.0))


_K5 = """, ca AS (SELECT draft_id, champion, ROW_NUMBER() OVER (PARTITION BY draft_id ORDER BY meta_strength DESC, champion) AS place FROM dr JOIN meta ON dr.patch = meta.patch WHERE NOT list_contains(list_concat(list_concat(bp, rp), list_concat(bb, rb)), champion)),
gn AS (SELECT draft_id, role, champion, ((draft_id * 7 + place * 13 + i * 5) % 41 - 5) / 4e0 AS gain FROM ca, (SELECT UNNEST(['top', 'jungle', 'mid', 'bot', 'support']) AS role, UNNEST([1, 2, 3, 4, 5]) AS i) WHERE place <= 5),
ok AS (SELECT * FROM gn WHERE gain >= 5e-1),
st AS (SELECT DISTINCT draft_id, 0 AS k, '' AS role, '' AS champion, 0e0 AS gain, CAST([] AS VARCHAR[]) AS rs, CAST([] AS VARCHAR[]) AS cs FROM ok
 UNION ALL SELECT draft_id, k + 1, role, champion, gain, list_append(rs, role), list_append(cs, champion) FROM (
  SELECT st.draft_id, st.k, ok.role, ok.champion, ok.gain, st.rs, st.cs, ROW_NUMBER() OVER (PARTITION BY st.draft_id ORDER BY ok.gain DESC, ok.role, ok.champion) AS rn
  FROM st JOIN ok ON st.draft_id = ok.draft_id WHERE st.k < 5 AND NOT list_contains(st.rs, ok.role) AND NOT list_contains(st.cs, ok.champion)) WHERE rn = 1)
SELECT draft_id, k AS place, role, champion, ROUND(gain, 6) AS gain FROM st WHERE k > 0"""


@query("k5_greedy_suggestions", with_views(_L + _META + _DR + _K5, "fx_wide").replace("WITH ", "WITH RECURSIVE ", 1))
def k5(spark, sf):
    d = drafts.resolve_suggestions(_gains(spark, sf).select("draft_id", "role", "champion", "gain"))
    return d.select("draft_id", "place", "role", "champion", r6("gain"))


_NAMES = """WITH kn AS (SELECT DISTINCT p_name AS name FROM part), al AS (SELECT 'alias of ' || name AS alias, name FROM kn WHERE name LIKE 'small%'),
q AS (SELECT upper(name) AS query FROM kn UNION SELECT 'alias of ' || name FROM kn WHERE name LIKE 'small%' UNION SELECT substr(name, 1, 2) || substr(name, 4) FROM kn UNION SELECT replace(name, 'e', 'aa') FROM kn UNION SELECT 'the ' || name FROM kn),
r AS (SELECT q.query, COALESCE(al.name, kn.name) AS resolved, CASE WHEN al.name IS NOT NULL THEN 'alias' WHEN kn.name IS NOT NULL THEN 'name' END AS how FROM q LEFT JOIN al ON lower(al.alias) = lower(q.query) LEFT JOIN kn ON lower(kn.name) = lower(trim(q.query))),
s AS (SELECT query, name, d, ROW_NUMBER() OVER (PARTITION BY query ORDER BY d, name) AS place FROM (SELECT r.query, kn.name, levenshtein(lower(trim(r.query)), lower(kn.name)) AS d FROM r, kn WHERE how IS NULL) WHERE d <= 2)
SELECT query, resolved, how, '' AS suggestion, 0 AS edit_distance, 0 AS place FROM r WHERE how IS NOT NULL
UNION ALL SELECT r.query, '', CASE WHEN s.name IS NULL THEN 'unknown' ELSE 'suggested' END, COALESCE(s.name, ''), CAST(COALESCE(d, 0) AS INT), CAST(COALESCE(place, 0) AS INT) FROM r LEFT JOIN s ON r.query = s.query AND place <= 3 WHERE how IS NULL"""


@query("j16_resolve_names", _NAMES)
def j16(spark, sf):
    kn = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    n = F.col("name")
    small = kn.filter(n.startswith("small"))
    al = small.select(F.concat(F.lit("alias of "), n).alias("alias"), "name")
    forms = F.array(F.upper(n), F.concat(F.substring(n, 1, 2), n.substr(F.lit(4), F.length(n))), F.replace(n, F.lit("e"), F.lit("aa")), F.concat(F.lit("the "), n))
    q = kn.select(F.explode(forms).alias("query")).unionByName(al.select(F.col("alias").alias("query")))
    return drafts.resolve_names(q, kn, al, 2, 3)


@query(
    "j18_teams_by_league",
    with_views(
        "SELECT league, STRING_AGG(team, ',' ORDER BY team) AS teams FROM (SELECT t.team, COALESCE(a.league, 'Other') AS league FROM (SELECT DISTINCT team FROM fx_matches) t LEFT JOIN (SELECT n_name AS team, r_name AS league FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') a ON t.team = a.team) GROUP BY league",
        "fx_matches",
    ),
)
def j18(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").filter("r_name <> 'ASIA'")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("team"), F.col("r_name").alias("league"))
    t = fx.matches(spark, sf).select("team").distinct()
    d = drafts.teams_by_league(t, a)
    # one entry per team name
    return d.groupBy("league").agg(F.array_join(F.array_sort(F.collect_set("team")), ",").alias("teams"))


@query(
    "p13_series_rollup",
    with_views(
        """, g AS (SELECT gameid, gameid // 10 AS series, CASE WHEN blue_won = 1 THEN 'Blue' ELSE 'Red' END AS winner FROM fx_pairs),
r AS (SELECT *, COUNT(*) FILTER (WHERE winner = 'Blue') OVER w AS b, COUNT(*) FILTER (WHERE winner = 'Red') OVER w AS d FROM g WINDOW w AS (PARTITION BY series ORDER BY gameid)),
k AS (SELECT * FROM r WHERE GREATEST(b - CASE WHEN winner = 'Blue' THEN 1 ELSE 0 END, d - CASE WHEN winner = 'Red' THEN 1 ELSE 0 END) < 3)
SELECT series, COUNT(*) AS games_played, MAX(b) AS blue_wins, MAX(d) AS red_wins, CASE WHEN MAX(b) >= 3 THEN 'Blue' WHEN MAX(d) >= 3 THEN 'Red' ELSE 'open' END AS series_winner FROM k GROUP BY series""",
        "fx_pairs",
    ),
)
def p13(spark, sf):
    # a series is five consecutive games
    m = fx.matches(spark, sf).filter("side = 'Blue'")
    g = m.select("gameid", F.floor(F.col("gameid") / 10).alias("series"), F.when(F.col("result") == 1, "Blue").otherwise("Red").alias("winner"))
    return drafts.series(g, "series", "gameid", "winner", 5)
