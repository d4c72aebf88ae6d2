"""Queries that run a stream over the tables to completion, and file sources.

Results and checkpoints go to a fresh folder under the session's shared
checkpoint folder.
"""

import uuid

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query, r6
from boutline.catalog.drift import recursive, series
from boutline.evaluation import drift
from boutline.fixtures import table, with_views
from boutline.session import checkpoint_dir
from boutline.sources import csv_matches
from boutline.streaming import jobs


def _room(spark, name):
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


@query(
    "t1_stream_deduplicate",
    "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS kept, CAST(1 AS BIGINT) AS kept_is_of_key FROM (SELECT user_id, event_type, ts, ROW_NUMBER() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts) AS r FROM events) WHERE r = 1 GROUP BY 1, 2, 3",
)
def t1(spark, sf):
    """One event of each user, type and day, as the stream wrote them. Which one of a
    micro-batch comes first is open, so the kept one is checked to be of its key."""
    room = _room(spark, "t1")
    ev = jobs.read_table_stream(spark, sf, "events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    d = jobs.deduplicated(ev, ["user_id", "event_type", "day"], "ts", "40 days").select("user_id", "event_type", "day", "event_id")
    q = d.writeStream.option("checkpointLocation", f"{room}/chk").trigger(availableNow=True).foreachBatch(jobs.append_batches(f"{room}/out")).start()
    q.awaitTermination()
    got = spark.read.option("basePath", f"{room}/out").parquet(f"{room}/out/batch=*")
    own = table(spark, sf, "events").select("event_id", F.col("user_id").alias("u"), F.col("event_type").alias("e"), F.date_format("ts", "yyyy-MM-dd").alias("d"))
    same = (F.col("user_id") == F.col("u")) & (F.col("event_type") == F.col("e")) & (F.col("day") == F.col("d"))
    return got.join(own, "event_id").groupBy("user_id", "day", "event_type").agg(F.count("*").alias("kept"), F.sum(same.cast("long")).alias("kept_is_of_key"))


_T2 = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, COUNT(*) AS rows, ROUND(AVG(CASE WHEN CAST(p_a >= 5e-1 AS INT) = y_true THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
 ROUND(AVG((p_a - y_true) * (p_a - y_true)), 6) AS brier, ROUND(AVG(-CASE WHEN y_true = 1 THEN LN(p_a) ELSE LN(1e0 - p_a) END), 6) AS log_loss FROM fx_preds GROUP BY 1"""


@query("t2_stream_rolling_metrics", with_views(_T2, "fx_preds"))
def t2(spark, sf):
    room = _room(spark, "t2")
    ev = jobs.read_table_stream(spark, sf, "events.parquet")
    y = F.when(F.col("value") > 35, 1).otherwise(0)
    p = ((F.col("event_id") * 37 % 101) / F.lit(101.0) * 0.5 + y * 0.3 + 0.05).alias("p")
    scored = jobs.with_event_time(ev, "ts").select("ts", y.alias("y_true"), p)
    jobs.run_available(jobs.rolling_metrics(scored, [], "ts", "1 day"), f"{room}/out", f"{room}/chk", "complete")
    d = spark.read.parquet(f"{room}/out")
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", r6("accuracy"), r6("brier"), r6("log_loss"))


@query(
    "t2_sliding_metrics",
    with_views(
        """, h AS (SELECT date_trunc('hour', ts) - (CAST(EXTRACT(hour FROM ts) AS INT) % 6) * INTERVAL 1 HOUR AS s0, p_a, y_true FROM fx_preds), s AS (SELECT s0 - k * INTERVAL 6 HOUR AS ws, p_a, y_true FROM h, (SELECT UNNEST([0, 1, 2, 3]) AS k))
SELECT strftime(ws, '%Y-%m-%d %H') AS window_start, COUNT(*) AS rows, ROUND(AVG((p_a - y_true) * (p_a - y_true)), 6) AS brier FROM s GROUP BY 1""",
        "fx_preds",
    ),
)
def t2s(spark, sf):
    p = fx.predictions(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "y_true", F.col("p_a").alias("p"))
    d = jobs.rolling_metrics(p, [], "ts", "24 hours", "6 hours")
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "rows", r6("brier"))


_PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(
    "t3_stream_form_state",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y FROM orders),
a AS (SELECT *, LAG(y) OVER {_W}) AS p FROM o), b AS (SELECT *, SUM(CASE WHEN p IS NULL OR p <> y THEN 1 ELSE 0 END) OVER {_W}) AS isl FROM a),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, isl ORDER BY o_orderdate, o_orderkey) * CASE WHEN y = 1 THEN 1 ELSE -1 END AS run FROM b),
d AS (SELECT o_orderkey, o_custkey, o_orderdate, COUNT(*) OVER {_W} {_PREV}) AS games_played, ROUND(COALESCE(AVG(CAST(y AS DOUBLE)) OVER {_W} {_PREV}), 5e-1), 6) AS overall_winrate,
 ROUND(COALESCE(AVG(CAST(y AS DOUBLE)) OVER {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 5e-1), 6) AS recent_winrate, CAST(COALESCE(LAG(run) OVER {_W}), 0) AS BIGINT) AS current_streak FROM c)
SELECT o_orderkey, o_custkey, games_played, overall_winrate, recent_winrate, current_streak FROM d WHERE o_orderdate < (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 61 DAY - INTERVAL 12 HOUR""",
)
def t3(spark, sf):
    """Orders arrive in five parts that overlap by up to 60 days, in no order within a
    part; every customer's form comes out as if they had come in order, up to the
    watermark."""
    room = _room(spark, "t3")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") > 250000).cast("int").alias("y"))
    days = F.datediff("o_orderdate", F.lit("1992-01-01")) + F.pmod(F.xxhash64("o_orderkey"), F.lit(60))
    part = F.least(F.greatest(F.floor(days / 600), F.lit(0)), F.lit(4)).cast("int")
    for i in range(5):  # a part is one micro-batch, whatever its files: each run takes what has come since the last
        o.filter(part == i).repartition(F.xxhash64("o_orderkey")).write.mode("append").parquet(f"{room}/in/part={i}")
        s = spark.readStream.schema(o.schema).option("recursiveFileLookup", "true").parquet(f"{room}/in")
        jobs.run_available(jobs.form_stream(s, "o_custkey", "o_orderdate", "y", "o_orderkey", "61 days 12 hours"), f"{room}/out", f"{room}/chk")
    return spark.read.parquet(f"{room}/out").select("o_orderkey", "o_custkey", "games_played", r6("overall_winrate"), r6("recent_winrate"), "current_streak")


@query("t4_stream_drift_monitor", recursive("SELECT model, series, position, window_size, form FROM rc, (SELECT UNNEST(['stream', 'batch']) AS form) WHERE position >= 0"))
def t4(spark, sf):
    """The series as a table written in three parts by time, each read by a stream run when
    it is there, beside the batch form."""
    room = _room(spark, "t4")
    points = series(spark, sf)
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-03-01"]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):  # a part is one micro-batch, whatever its files
        part = points.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
        part.write.mode("append").parquet(f"{room}/points/part={i}")
        s = spark.readStream.schema(points.schema).option("recursiveFileLookup", "true").parquet(f"{room}/points")
        jobs.run_available(jobs.drift_stream(s, ["model", "series"], ["ts", "event_id"], "v"), f"{room}/out", f"{room}/chk")
    got = spark.read.schema("model string, series string, position long, window_size long").parquet(f"{room}/out")
    stored = spark.read.schema(points.schema).option("recursiveFileLookup", "true").parquet(f"{room}/points")
    batch = drift.adaptive_sequence(stored, ["model", "series"], ["ts", "event_id"], "v")
    return got.withColumn("form", F.lit("stream")).unionByName(batch.withColumn("form", F.lit("batch")))


@query(
    "t5_sessions",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events),
b AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_event, COUNT(*) AS events FROM b GROUP BY user_id, s""",
)
def t5(spark, sf):
    """Sessions that the watermark closed, appended once each, and the open ones merged in
    when read; the stream runs twice on the same checkpoint, which adds nothing."""
    room = _room(spark, "t5")
    for _ in range(2):
        ev = jobs.with_event_time(jobs.read_table_stream(spark, sf, "events.parquet"), "ts", "1 hour")
        jobs.run_available(jobs.sessions(ev, ["user_id"], "ts", "6 hours"), f"{room}/out", f"{room}/chk")
    closed = spark.read.schema("user_id long, session_start timestamp, last_event timestamp, events long").parquet(f"{room}/out")
    rows = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return closed.unionByName(jobs.open_sessions(rows, closed, ["user_id"], "ts", "6 hours")).select("user_id", t("session_start"), t("last_event"), "events")


def _files(spark, sf, name):
    """The player rows as yearly CSV folders, written by Spark."""
    room = _room(spark, name)
    p = fx.player_rows(spark, sf).select(
        F.concat(F.col("year").cast("string"), F.lit("_match_data")).alias("file"),
        "gameid", "league", F.date_format("match_date", "yyyy-MM-dd").alias("date"), "patch", F.col("split_name").alias("split"),
        F.concat_ws("@", "team", "row_id").alias("teamname"), "side", "result", "champion", "position", "playername", "kills", "totalgold",
    )
    p.write.partitionBy("file").option("header", True).csv(f"{room}/by_year")
    return room


@query("a1_scan_year_files", with_views("SELECT year, COUNT(*) AS rows, COUNT(DISTINCT gameid) AS games FROM fx_players GROUP BY year", "fx_players"))
def a1(spark, sf):
    room = _files(spark, sf, "a1")
    return csv_matches.scan(spark, f"{room}/by_year/file=*_match_data*").groupBy("year").agg(F.count("*").alias("rows"), F.countDistinct("gameid").alias("games"))


@query("a10_overview", with_views("SELECT year, COUNT(*) AS rows, 1 AS has_files FROM fx_players GROUP BY year", "fx_players"))
def a10(spark, sf):
    room = _files(spark, sf, "a10")
    d = csv_matches.overview(spark, f"{room}/by_year/file=*_match_data*")
    # how many files and bytes a year has depends on the run
    return d.select("year", "rows", ((F.col("files") > 0) & (F.col("bytes") > 0)).cast("int").alias("has_files"))


@query(
    "a11_ingest",
    with_views(
        """, t AS (SELECT gameid, row_id, team, year, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN position <> 'team' THEN position END) AS k FROM fx_players GROUP BY 1, 2, 3, 4)
SELECT year, COUNT(*) AS rows FROM t WHERE n >= 4 AND k >= 3 GROUP BY year""",
        "fx_players",
    ),
)
def a11(spark, sf):
    """A full load of the files up to 1997, then an increment of all of them."""
    room = _files(spark, sf, "a11")
    leagues = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    csv_matches.full_load(spark, f"{room}/by_year/file=199[0-7]_match_data*", f"{room}/store", leagues, min_games=1)
    csv_matches.incremental_load(spark, f"{room}/by_year/file=*_match_data*", f"{room}/store", leagues, min_games=1)
    return spark.read.parquet(f"{room}/store/data").groupBy("year").agg(F.count("*").alias("rows"))
