"""Match, player and prediction tables derived from the driver's tables.

The same views exist as SQL (``SQL``) for the oracles. Everything is computed
over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.roles import ROLE_PREFIX, UNKNOWN


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the entity names; nation and region have 25 and 5 rows."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf, "orders")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("gameid"),
            "o_custkey",
            "o_totalprice",
            F.to_date("o_orderdate").alias("d"),
            F.col("o_orderpriority").alias("split_name"),
            F.col("n_name").alias("team"),
            F.col("r_name").alias("region"),
        )
    )


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Team-match rows: two per game, one aggregation by game instead of a self-join."""
    o = orders(spark, sf)
    one = F.struct("o_orderkey", "d", "o_custkey", "region", "split_name", "team", "o_totalprice")
    even = F.col("o_orderkey") % 2 == 0
    g = (
        o.groupBy("gameid")
        .agg(F.max(F.when(even, one)).alias("b"), F.max(F.when(~even, one)).alias("r"))
        .filter(F.col("b").isNotNull() & F.col("r").isNotNull())
        .withColumn("blue_won", (F.col("b.o_totalprice") >= F.col("r.o_totalprice")).cast("int"))
    )

    def side(s, name, won):
        return F.struct(
            F.col(f"{s}.o_orderkey").alias("row_id"),
            F.col(f"{s}.team").alias("team"),
            F.col(f"{s}.o_custkey").alias("o_custkey"),
            F.lit(name).alias("side"),
            won.alias("result"),
        )

    both = F.array(side("b", "Blue", F.col("blue_won")), side("r", "Red", 1 - F.col("blue_won")))
    return (
        g.select("gameid", F.col("b.d").alias("match_date"), F.col("b.region").alias("league"), F.col("b.split_name").alias("split_name"), F.explode(both).alias("x"))
        .select(
            "gameid",
            F.col("x.row_id").alias("row_id"),
            "match_date",
            F.year("match_date").alias("year"),
            F.concat_ws(".", (F.year("match_date") - 1990).cast("string"), F.month("match_date").cast("string")).alias("patch"),
            "league",
            "split_name",
            F.col("x.team").alias("team"),
            F.col("x.side").alias("side"),
            F.col("x.result").alias("result"),
            F.col("x.o_custkey").alias("o_custkey"),
        )
    )


def picks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 5")
    return li.groupBy("l_orderkey").agg(
        *[
            F.coalesce(
                F.concat(F.lit("C"), (F.max(F.when(F.col("l_linenumber") == i, F.col("l_partkey"))) % 60).cast("string")),
                F.lit(UNKNOWN),
            ).alias(f"{p}_champion")
            for i, p in enumerate(ROLE_PREFIX, 1)
        ]
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The full team-match row: context, champions, players, bans, length."""
    m = matches(spark, sf)
    p = picks(spark, sf)
    row = F.col("row_id")
    out = m.join(p, m.row_id == p.l_orderkey, "left")
    return out.select(
        "gameid", "row_id", "match_date", "year", "patch", "league", "split_name", "team", "side", "result",
        (F.col("gameid") % 10 == 0).cast("int").alias("playoffs"),
        (F.lit(20.0) + F.col("gameid") % 25).alias("game_length"),
        *[F.coalesce(f"{x}_champion", F.lit(UNKNOWN)).alias(f"{x}_champion") for x in ROLE_PREFIX],
        *[F.concat_ws("_", "team", F.lit(x), (F.col("o_custkey") % 3).cast("string")).alias(f"{x}_player") for x in ROLE_PREFIX],
        *[
            F.when((row + i) % 11 == 0, F.lit("NoBan"))
            .otherwise(F.concat(F.lit("C"), ((row * 7 + i * 13) % 60).cast("string")))
            .alias(f"ban{i}")
            for i in range(1, 6)
        ],
    )


def player_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw player-level rows: a line item is a player of its order's team.

    ``ord`` makes the file order explicit; line numbers 6 and 7 are team rows.
    """
    m = matches(spark, sf)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    pos = F.element_at(F.array(*[F.lit(x) for x in ("top", "jungle", "middle", "adc", "support", "team", "team")]), F.col("l_linenumber"))
    return (
        li.join(m, li.l_orderkey == m.row_id)
        .select(
            "gameid", "row_id", "match_date", "year", "patch", "league", "split_name", "team", "side", "result",
            pos.alias("position"),
            F.concat(F.lit("C"), (F.col("l_partkey") % 60).cast("string")).alias("champion"),
            F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("playername"),
            (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("ord"),
            F.col("l_quantity").alias("kills"),
            F.col("l_extendedprice").alias("totalgold"),
        )
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.col("value") > 35, 1).otherwise(0)
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", y.alias("y_true"),
        ((F.col("event_id") * 37 % 101) / F.lit(101.0) * 0.5 + y * 0.3 + 0.05).alias("p_a"),
        ((F.col("event_id") * 53 % 97) / F.lit(97.0) * 0.6 + y * 0.2 + 0.1).alias("p_b"),
    )


def predictions_long(spark: SparkSession, sf: str) -> DataFrame:
    """(model, event_id, ts, user_id, y_true, p) for both models, one scan."""
    p = predictions(spark, sf)
    return p.select(
        "event_id", "user_id", "ts", "y_true",
        F.explode(F.array(
            F.struct(F.lit("a").alias("model"), F.col("p_a").alias("p")),
            F.struct(F.lit("b").alias("model"), F.col("p_b").alias("p")),
        )).alias("x"),
    ).select("x.model", "event_id", "user_id", "ts", "y_true", "x.p")


_ROLE_MAX = ",\n".join(
    f"COALESCE('C' || CAST(MAX(CASE WHEN l_linenumber = {i} THEN l_partkey END) % 60 AS VARCHAR), 'Unknown') AS {p}_champion"
    for i, p in enumerate(ROLE_PREFIX, 1)
)
_WIDE_COLS = ",\n".join(
    [f"COALESCE(p.{x}_champion, 'Unknown') AS {x}_champion" for x in ROLE_PREFIX]
    + [f"m.team || '_{x}_' || CAST(m.o_custkey % 3 AS VARCHAR) AS {x}_player" for x in ROLE_PREFIX]
    + [f"CASE WHEN (m.row_id + {i}) % 11 = 0 THEN 'NoBan' ELSE 'C' || CAST((m.row_id * 7 + {i} * 13) % 60 AS VARCHAR) END AS ban{i}" for i in range(1, 6)]
)

# The views as CTEs for the SQL oracles.
SQL = {
    "fx_orders": """SELECT o.o_orderkey, o.o_orderkey - o.o_orderkey % 2 AS gameid, o.o_custkey, o.o_totalprice,
  CAST(o.o_orderdate AS DATE) AS d, o.o_orderpriority AS split_name, n.n_name AS team, r.r_name AS region
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_pairs": """SELECT b.gameid, b.d AS match_date, CAST(EXTRACT(YEAR FROM b.d) AS INT) AS year,
  CAST(EXTRACT(YEAR FROM b.d) - 1990 AS VARCHAR) || '.' || CAST(EXTRACT(MONTH FROM b.d) AS VARCHAR) AS patch,
  b.region AS league, b.split_name, b.o_orderkey AS b_row, r.o_orderkey AS r_row, b.team AS b_team, r.team AS r_team,
  b.o_custkey AS b_cust, r.o_custkey AS r_cust, CASE WHEN b.o_totalprice >= r.o_totalprice THEN 1 ELSE 0 END AS blue_won
  FROM fx_orders b JOIN fx_orders r ON b.gameid = r.gameid AND b.o_orderkey % 2 = 0 AND r.o_orderkey % 2 = 1""",
    "fx_matches": """SELECT gameid, b_row AS row_id, match_date, year, patch, league, split_name, b_team AS team, 'Blue' AS side, blue_won AS result, b_cust AS o_custkey FROM fx_pairs
  UNION ALL SELECT gameid, r_row, match_date, year, patch, league, split_name, r_team, 'Red', 1 - blue_won, r_cust FROM fx_pairs""",
    "fx_picks": f"SELECT l_orderkey, {_ROLE_MAX} FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_orderkey",
    "fx_wide": f"""SELECT m.gameid, m.row_id, m.match_date, m.year, m.patch, m.league, m.split_name, m.team, m.side, m.result,
  CASE WHEN m.gameid % 10 = 0 THEN 1 ELSE 0 END AS playoffs, 20e0 + m.gameid % 25 AS game_length, {_WIDE_COLS}
  FROM fx_matches m LEFT JOIN fx_picks p ON m.row_id = p.l_orderkey""",
    "fx_players": """SELECT m.gameid, m.row_id, m.match_date, m.year, m.patch, m.league, m.split_name, m.team, m.side, m.result,
  CASE l_linenumber WHEN 1 THEN 'top' WHEN 2 THEN 'jungle' WHEN 3 THEN 'middle' WHEN 4 THEN 'adc' WHEN 5 THEN 'support' ELSE 'team' END AS position,
  'C' || CAST(l_partkey % 60 AS VARCHAR) AS champion, 'P' || CAST(l_suppkey AS VARCHAR) AS playername,
  CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS ord, l_quantity AS kills, l_extendedprice AS totalgold
  FROM lineitem l JOIN fx_matches m ON l.l_orderkey = m.row_id""",
    "fx_preds": """SELECT event_id, user_id, ts, y_true,
  (event_id * 37 % 101) / 101e0 * 5e-1 + y_true * 3e-1 + 5e-2 AS p_a,
  (event_id * 53 % 97) / 97e0 * 6e-1 + y_true * 2e-1 + 1e-1 AS p_b
  FROM (SELECT event_id, user_id, ts, CASE WHEN value > 35 THEN 1 ELSE 0 END AS y_true FROM events) e""",
    "fx_long": """SELECT 'a' AS model, event_id, user_id, ts, y_true, p_a AS p FROM fx_preds
  UNION ALL SELECT 'b', event_id, user_id, ts, y_true, p_b FROM fx_preds""",
}
_NEEDS = {
    "fx_orders": [], "fx_pairs": ["fx_orders"], "fx_matches": ["fx_pairs"], "fx_picks": [],
    "fx_wide": ["fx_matches", "fx_picks"], "fx_players": ["fx_matches"], "fx_preds": [], "fx_long": ["fx_preds"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs. ``sql`` may start with further CTEs
    written as ``, name AS (...)``."""
    got: list[str] = []

    def add(n):
        for d in _NEEDS[n]:
            add(d)
        if n not in got:
            got.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in got) + "\n" + sql


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Every game as a prospective draft, some of them spoiled on purpose."""
    from boutline.operators.lookups import game_pairs
    from boutline.roles import ROLES

    w = wide(spark, sf)
    cols = ["team", "patch", "league", "split_name", "year", "playoffs", *[f"{p}_champion" for p in ROLE_PREFIX], *[f"{p}_player" for p in ROLE_PREFIX], *[f"ban{i}" for i in range(1, 6)]]
    g = game_pairs(w, cols)
    i = F.col("gameid")

    def picks_of(s):
        full = F.map_from_arrays(F.array(*[F.lit(r) for r in ROLES]), F.array(*[F.col(f"{s}_{p}_champion") for p in ROLE_PREFIX]))
        return F.when((i % 26 == 0) & F.lit(s == "red"), F.map_filter(full, lambda k, v: k != "mid")).otherwise(full)

    def bans_of(s):
        full = F.array(*[F.col(f"{s}_ban{k}") for k in range(1, 6)])
        return F.when((i % 22 == 0) & F.lit(s == "blue"), F.slice(full, 1, 4)).otherwise(full)

    players = lambda s: F.map_from_arrays(F.array(*[F.lit(r) for r in ROLES]), F.array(*[F.col(f"{s}_{p}_player") for p in ROLE_PREFIX]))
    return g.select(
        i.alias("draft_id"), F.when(i % 34 == 0, F.lit("Nowhere")).otherwise(F.col("blue_team")).alias("blue_team"), F.col("red_team"),
        picks_of("blue").alias("blue_picks"), picks_of("red").alias("red_picks"), bans_of("blue").alias("blue_bans"), bans_of("red").alias("red_bans"),
        players("blue").alias("blue_players"), players("red").alias("red_players"),
        F.col("blue_patch").alias("patch"), F.col("blue_league").alias("league"), F.col("blue_split_name").alias("split_name"),
        F.col("blue_year").alias("year"), F.col("blue_playoffs").alias("playoffs"),
    )
