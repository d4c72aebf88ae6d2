"""Queries over projections, filters, schema operators and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import day, query, r6
from boutline.fixtures import table, with_views
from boutline.operators import filters, schema, setops
from boutline.roles import ROLE_PREFIX, Roles

EV = Roles(row="event_id", time="ts", entity="event_type")


@query("a2_known_columns", with_views("SELECT gameid, league, patch, side, result, CAST(EXTRACT(YEAR FROM match_date) AS INT) AS year FROM fx_matches", "fx_matches"))
def a2(spark, sf):
    d = fx.matches(spark, sf).drop("year")
    wanted = ["gameid", "league", "match_date", "patch", "side", "result", "not_there"]
    return filters.project_known(d, wanted, "match_date").drop("match_date")


_COLS = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"), ("c_mktsegment", "string")]
_A3 = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, COUNT(*) AS row_count, 'unknown' AS layout FROM customer" for c, t in _COLS
)


@query("a3_detect_schema", _A3)
def a3(spark, sf):
    return schema.detect_schema(table(spark, sf, "customer")).drop("sample")


_FIND = """SELECT 'error' AS level, 'missing_required' AS kind, UNNEST(['date', 'teamname', 'playoffs', 'ban1', 'ban2', 'ban3', 'ban4', 'ban5']) AS column_name, '' AS detail
UNION ALL SELECT 'warning', 'missing_recommended', UNNEST(['split', 'position', 'champion', 'gamelength']), ''
UNION ALL SELECT 'info', 'extra_column', UNNEST(['row_id', 'match_date', 'split_name', 'team', 'o_custkey']), ''
UNION ALL SELECT 'error', 'result_domain', 'result', CAST(COUNT(*) AS VARCHAR) FROM fx_matches WHERE row_id % 7 = 0"""


@query("a4_validate_schema", with_views(_FIND, "fx_matches"))
def a4(spark, sf):
    # every seventh outcome is spoiled, so that the domain check finds something
    m = fx.matches(spark, sf)
    bad = m.withColumn("result", F.when(F.col("row_id") % 7 == 0, F.lit(2)).otherwise(F.col("result")))
    return schema.validate_schema(bad)


@query(
    "a5_adapt_schema",
    with_views(
        """SELECT row_id, team AS teamname, CASE WHEN row_id % 5 = 0 THEN 0 ELSE result END AS result, 0 AS playoffs, 'Unknown' AS top, strftime(match_date, '%Y-%m-%d') AS day FROM fx_matches""",
        "fx_matches",
    ),
)
def a5(spark, sf):
    m = fx.matches(spark, sf)
    raw = m.select(
        "row_id", "team", F.when(F.col("row_id") % 5 == 0, "n/a").otherwise(F.col("result").cast("string")).alias("result"),
        F.date_format("match_date", "yyyy-MM-dd").alias("date"),
    )
    d = schema.adapt_schema(raw, {"team": "teamname"}, {"playoffs": 0, "top": "Unknown"}, ["result", "playoffs"], ["date"])
    return d.select("row_id", "teamname", "result", "playoffs", "top", day("date", "day"))


@query(
    "a6_compare_schemas",
    """SELECT column_name, status, dtype_a, dtype_b, CAST(0 AS BIGINT) AS nulls_a, CASE column_name WHEN 'extra' THEN (SELECT COUNT(*) FILTER (WHERE c_acctbal < 0) FROM customer) ELSE 0 END AS nulls_b
 FROM (VALUES ('c_name', 'only_first', 'string', ''), ('c_nationkey', 'only_first', 'integer', ''), ('c_mktsegment', 'only_first', 'string', ''), ('c_custkey', 'same', 'integer', 'integer'),
 ('c_acctbal', 'type_differs', 'float', 'integer'), ('extra', 'only_second', '', 'string')) t(column_name, status, dtype_a, dtype_b)""",
)
def a6(spark, sf):
    c = table(spark, sf, "customer")
    other = c.select("c_custkey", F.col("c_acctbal").cast("long").alias("c_acctbal"), F.when(F.col("c_acctbal") >= 0, "x").alias("extra"))
    return schema.compare_schemas(c, other)


@query("b1_target_leagues", with_views("SELECT league, COUNT(*) AS rows FROM fx_matches WHERE league IN ('ASIA', 'EUROPE') GROUP BY league", "fx_matches"))
def b1(spark, sf):
    return filters.in_leagues(fx.matches(spark, sf), ["ASIA", "EUROPE"]).groupBy("league").agg(F.count("*").alias("rows"))


@query("b2_canonical_league", with_views("SELECT row_id, CASE league WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' ELSE league END AS league FROM fx_matches", "fx_matches"))
def b2(spark, sf):
    return filters.canonical_league(fx.matches(spark, sf), names={"ASIA": "AS", "EUROPE": "EU"}).select("row_id", "league")


@query("b3_drop_leaks", with_views("SELECT gameid, position, COUNT(*) AS rows FROM fx_players GROUP BY 1, 2", "fx_players"))
def b3(spark, sf):
    d = filters.drop_leak_columns(fx.player_rows(spark, sf))
    assert "kills" not in d.columns and "totalgold" not in d.columns
    return d.groupBy("gameid", "position").agg(F.count("*").alias("rows"))


@query("b4_exclude_entities", with_views("SELECT row_id, team FROM fx_matches WHERE NOT contains(lower(team), 'nation_1') AND NOT contains(lower(team), '20') AND team <> 'NATION_5'", "fx_matches"))
def b4(spark, sf):
    return filters.exclude_entities(fx.matches(spark, sf), ["Nation_1", "20"], ["NATION_5"]).select("row_id", "team")


@query("b5_min_games", with_views("SELECT row_id, team FROM fx_matches WHERE team IN (SELECT team FROM fx_matches GROUP BY team HAVING COUNT(*) >= 600)", "fx_matches"))
def b5(spark, sf):
    return filters.min_games(fx.matches(spark, sf), 600).select("row_id", "team")


@query("b6_valid_rows", with_views("SELECT row_id, result FROM fx_matches WHERE row_id % 5 <> 0 AND row_id % 7 <> 0 AND row_id % 11 <> 0 AND row_id % 13 <> 0", "fx_matches"))
def b6(spark, sf):
    i = F.col("row_id")
    raw = fx.matches(spark, sf).select(
        "row_id", F.when(i % 5 != 0, F.col("team")).alias("team"), "league",
        F.when(i % 7 == 0, "won").when(i % 11 == 0, "3").otherwise(F.col("result").cast("string")).alias("result"),
        F.when(i % 13 == 0, "soon").otherwise(F.date_format("match_date", "yyyy-MM-dd")).alias("date"),
    )
    return filters.valid_rows(raw, "result", "date", ["league", "team", "result"]).select("row_id", "result")


@query(
    "b7_fill_missing",
    with_views(
        """SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'Unknown' ELSE top_champion END AS top_champion, CASE WHEN row_id % 4 = 0 THEN 'NoBan' ELSE ban1 END AS ban1,
 CASE WHEN row_id % 6 = 0 THEN 2023e0 ELSE CAST(year AS DOUBLE) END AS year, CASE WHEN row_id % 9 = 0 THEN 30e0 ELSE game_length END AS game_length FROM fx_wide""",
        "fx_wide",
    ),
)
def b7(spark, sf):
    i = F.col("row_id")
    raw = fx.wide(spark, sf).withColumns(
        {
            "top_champion": F.when(i % 3 == 0, "nan").otherwise(F.col("top_champion")),
            "ban1": F.when(i % 4 != 0, F.col("ban1")),
            "year": F.when(i % 6 != 0, F.col("year")),
            "game_length": F.when(i % 9 != 0, F.col("game_length")),
        }
    )
    return filters.fill_missing(raw).select("row_id", "top_champion", "ban1", "year", "game_length")


@query(
    "b8_similar_names",
    """SELECT DISTINCT name, target FROM (SELECT DISTINCT n_name AS name FROM nation) a, (SELECT UNNEST(['nation_1', 'NATION_2', 'ion', 'NATIONS', 'xNation_3y', 'AMERICA']) AS target) b
WHERE contains(lower(name), lower(target)) OR contains(lower(target), lower(name)) OR (target = 'AMERICA' AND contains(lower(name), '_24'))""",
)
def b8(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    t = spark.createDataFrame([(x,) for x in ("nation_1", "NATION_2", "ion", "NATIONS", "xNation_3y", "AMERICA")], "target string")
    return filters.similar_names(names, t, "name", "target", {"AMERICA": ["_24"]})


@query(
    "b9_positions",
    with_views(
        "SELECT gameid, team, CASE position WHEN 'jungle' THEN 'jng' WHEN 'middle' THEN 'mid' WHEN 'adc' THEN 'bot' WHEN 'support' THEN 'sup' ELSE position END AS position, COUNT(*) AS rows FROM fx_players WHERE position <> 'team' GROUP BY 1, 2, 3",
        "fx_players",
    ),
)
def b9(spark, sf):
    return filters.normal_position(fx.player_rows(spark, sf)).groupBy("gameid", "team", "position").agg(F.count("*").alias("rows"))


@query("b10_rolling_window", with_views("SELECT row_id, result FROM fx_matches WHERE match_date >= (SELECT MAX(match_date) FROM fx_matches) - 360", "fx_matches"))
def b10(spark, sf):
    m = fx.matches(spark, sf)
    return filters.rolling_window(m, m.agg(F.max("match_date")).scalar(), 12).select("row_id", "result")


@query(
    "b11_patch_numbers",
    with_views(
        "SELECT row_id, CAST(split_part(patch, '.', 1) AS INT) * 100 + CAST(split_part(patch, '.', 2) AS INT) AS patch_number, CAST(split_part(patch, '.', 1) AS INT) AS patch_major, CAST(split_part(patch, '.', 2) AS INT) AS patch_minor FROM fx_matches",
        "fx_matches",
    ),
)
def b11(spark, sf):
    return filters.patch_columns(fx.matches(spark, sf)).select("row_id", "patch_number", "patch_major", "patch_minor")


@query(
    "b12_fill_context",
    with_views(
        """, l AS (SELECT patch FROM fx_matches ORDER BY match_date DESC, row_id DESC LIMIT 1), t AS (SELECT team, league, split_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY match_date DESC, row_id DESC) AS k FROM fx_matches) WHERE k = 1),
d AS (SELECT c_custkey AS draft_id, n_name AS team, CASE WHEN c_custkey % 2 = 0 THEN '5.' || CAST(c_custkey % 12 + 1 AS VARCHAR) END AS patch FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT draft_id, COALESCE(d.patch, l.patch) AS patch, CAST(split_part(COALESCE(d.patch, l.patch), '.', 1) AS INT) + 2010 AS year, 0 AS playoffs, COALESCE(t.league, 'Unknown') AS league, COALESCE(t.split_name, 'Unknown') AS split FROM d JOIN l ON TRUE LEFT JOIN t ON d.team = t.team""",
        "fx_matches",
    ),
)
def b12(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("c_custkey")
    drafts = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("draft_id"), F.col("n_name").alias("team"), F.when(k % 2 == 0, F.concat(F.lit("5."), (k % 12 + 1).cast("string"))).alias("patch")
    )
    return filters.fill_context(drafts, fx.matches(spark, sf)).select("draft_id", "patch", "year", "playoffs", "league", "split")


_PIV_CTX = "FIRST_VALUE"
_PIV = """, p AS (SELECT *, CASE position WHEN 'jungle' THEN 'jng' WHEN 'middle' THEN 'mid' WHEN 'adc' THEN 'bot' WHEN 'support' THEN 'sup' WHEN 'top' THEN 'top' END AS pos FROM fx_players),
g AS (SELECT gameid, row_id, team, MIN(league) AS league, MIN(side) AS side, MIN(result) AS result, COUNT(*) AS n,
 COALESCE(ARG_MAX(champion, ord) FILTER (WHERE pos = 'top'), 'Unknown') AS top_champion, COALESCE(ARG_MAX(champion, ord) FILTER (WHERE pos = 'jng'), 'Unknown') AS jng_champion,
 COALESCE(ARG_MAX(champion, ord) FILTER (WHERE pos = 'mid'), 'Unknown') AS mid_champion, COALESCE(ARG_MAX(champion, ord) FILTER (WHERE pos = 'bot'), 'Unknown') AS bot_champion,
 COALESCE(ARG_MAX(champion, ord) FILTER (WHERE pos = 'sup'), 'Unknown') AS sup_champion FROM p GROUP BY gameid, row_id, team)
SELECT gameid, row_id, team, league, side, result, top_champion, jng_champion, mid_champion, bot_champion, sup_champion FROM g
WHERE n >= 4 AND CAST(top_champion = 'Unknown' AS INT) + CAST(jng_champion = 'Unknown' AS INT) + CAST(mid_champion = 'Unknown' AS INT) + CAST(bot_champion = 'Unknown' AS INT) + CAST(sup_champion = 'Unknown' AS INT) <= 2"""


@query("d1_player_to_team_pivot", with_views(_PIV, "fx_players"))
def d1(spark, sf):
    # a game may be a team against itself, so the side's row id is part of the key
    p = fx.player_rows(spark, sf).withColumn("entity", F.struct("row_id", "team"))
    d = setops.team_rows_from_players(p, "ord", ["league", "side", "result"], Roles(entity="entity"))
    return d.select(
        "gameid", F.col("entity.row_id").alias("row_id"), F.col("entity.team").alias("team"), "league", "side", "result",
        "top_champion", "jng_champion", "mid_champion", "bot_champion", "sup_champion",
    )


@query("j10_new_games", with_views("SELECT row_id, gameid FROM fx_matches WHERE gameid NOT IN (SELECT gameid FROM fx_matches WHERE year < 1999)", "fx_matches"))
def j10(spark, sf):
    m = fx.matches(spark, sf)
    return setops.new_games(m, m.filter("year < 1999")).select("row_id", "gameid")


@query("s1_union_years", with_views("SELECT year, COUNT(*) AS rows, COUNT(CASE WHEN year >= 1995 THEN side END) AS sides FROM fx_matches GROUP BY year", "fx_matches"))
def s1(spark, sf):
    m = fx.matches(spark, sf)
    d = setops.union_years([m.filter("year < 1995").drop("side"), m.filter("year >= 1995")])
    return d.groupBy("year").agg(F.count("*").alias("rows"), F.count("side").alias("sides"))


@query(
    "s2_mirror",
    with_views(
        "SELECT row_id, result, side, 0 AS is_augmented FROM fx_matches UNION ALL SELECT row_id, 1 - result, CASE side WHEN 'Blue' THEN 'Red' ELSE 'Blue' END, 1 FROM fx_matches",
        "fx_matches",
    ),
)
def s2(spark, sf):
    return setops.mirror(fx.matches(spark, sf)).select("row_id", "result", "side", F.col("is_augmented").cast("int").alias("is_augmented"))


@query("d25_mirror_sizes", with_views("SELECT COUNT(*) AS original_rows, 2 * COUNT(*) AS augmented_rows, 2e0 AS ratio FROM fx_matches", "fx_matches"))
def d25(spark, sf):
    m = fx.matches(spark, sf)
    return setops.mirror_sizes(m, setops.mirror(m))


_DEDUP = """SELECT l_orderkey, l_linenumber, l_partkey, src FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src {0}, l_partkey {0}, l_suppkey {0}, l_extendedprice {0}) AS k
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS src FROM lineitem)) WHERE k = 1"""


def _halves(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    tag = F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("src")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", tag)
    return li.filter("src = 0"), li.filter("src = 1")


@query("s3_upsert_keep_last", _DEDUP.format("DESC"))
def s3(spark, sf):
    old, new = _halves(spark, sf)
    d = setops.upsert(old, new, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "src")


@query("s4_insert_keep_first", _DEDUP.format("ASC"))
def s4(spark, sf):
    old, new = _halves(spark, sf)
    d = setops.insert_only(old, new, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "src")


@query("s5_two_sided_games", with_views("SELECT gameid FROM fx_matches WHERE side = 'Blue' AND result = 1 INTERSECT SELECT gameid FROM fx_matches WHERE side = 'Red'", "fx_matches"))
def s5(spark, sf):
    m = fx.matches(spark, sf)
    return setops.two_sided_games(m.filter((F.col("side") == "Red") | (F.col("result") == 1)))


_S6 = """, c AS (SELECT DISTINCT patch, c FROM (""" + " UNION ALL ".join(f"SELECT patch, {p}_champion AS c FROM fx_wide" for p in ROLE_PREFIX) + """)),
o AS (SELECT patch, LEAD(patch) OVER (ORDER BY CAST(split_part(patch, '.', 1) AS INT), CAST(split_part(patch, '.', 2) AS INT)) AS next_patch FROM (SELECT DISTINCT patch FROM c))
SELECT o.patch, o.next_patch, COUNT(DISTINCT c.c) AS champions FROM o JOIN c ON c.patch = o.patch OR c.patch = o.next_patch WHERE o.next_patch IS NOT NULL GROUP BY 1, 2"""


@query("s6_champion_union", with_views(_S6, "fx_wide"))
def s6(spark, sf):
    """Champions of two consecutive patches, by version, in any role."""
    w = fx.wide(spark, sf)
    c = w.select("patch", F.explode(F.array(*[f"{p}_champion" for p in ROLE_PREFIX])).alias("c")).distinct()
    part = lambda i: F.split_part("patch", F.lit("."), F.lit(i)).cast("int")
    # one row a patch, as short as the calendar
    pairs = c.select("patch").distinct().withColumn("next_patch", F.lead("patch").over(Window.orderBy(part(1), part(2)))).dropna(subset=["next_patch"])
    both = pairs.select(F.explode(F.array("patch", "next_patch")).alias("of"), F.col("patch").alias("first"), "next_patch")
    d = c.join(both, c["patch"] == both["of"]).select("first", "next_patch", "c").distinct()
    return d.groupBy(F.col("first").alias("patch"), "next_patch").agg(F.count("*").alias("champions"))


@query(
    "a7_metadata",
    with_views(
        """SELECT COUNT(*) AS rows, COUNT(DISTINCT gameid) AS games, strftime(MIN(match_date), '%Y-%m-%d') AS first_date, strftime(MAX(match_date), '%Y-%m-%d') AS last_date,
 (SELECT STRING_AGG(league || '=' || CAST(n AS VARCHAR), ',' ORDER BY league) FROM (SELECT league, COUNT(*) AS n FROM fx_matches GROUP BY league)) AS leagues,
 (SELECT STRING_AGG(CAST(year AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY year) FROM (SELECT year, COUNT(*) AS n FROM fx_matches GROUP BY year)) AS years FROM fx_matches""",
        "fx_matches",
    ),
)
def a7(spark, sf):
    from boutline.sources.snapshots import metadata

    d = metadata(fx.matches(spark, sf))
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string"))), ",")
    return d.select("rows", "games", day("first_date"), day("last_date"), flat("leagues").alias("leagues"), flat("years").alias("years"))


@query(
    "a8_version_tag",
    with_views(
        "SELECT 'v' || strftime(MAX(match_date), '%Y.%m.%d') || '_' || substr(md5(CAST(COUNT(*) AS VARCHAR) || '_' || CAST(COUNT(DISTINCT gameid) AS VARCHAR) || '_' || strftime(MAX(match_date), '%Y-%m-%d')), 1, 8) AS tag FROM fx_matches",
        "fx_matches",
    ),
)
def a8(spark, sf):
    from boutline.sources.snapshots import version_tag

    m = fx.matches(spark, sf)
    return version_tag(m, F.max("match_date"))
