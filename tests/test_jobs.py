"""Sinks, ingest, streams and models from end to end."""

import pytest
from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.evaluation import drift
from boutline.ml import lifecycle, training
from boutline.ml.scoring import DraftScorer
from boutline.operators import form, splits
from boutline.operators.features import CANONICAL_48, FeatureModel
from boutline.roles import ROLES
from boutline.session import cut_lineage
from boutline.sources import snapshots
from boutline.streaming import jobs


@pytest.fixture(scope="module")
def wide(spark, sf):
    return cut_lineage(fx.wide(spark, sf))


def test_snapshots(spark, sf, tmp_path, wide):
    root, target = f"{tmp_path}/store", f"{tmp_path}/live"
    tag1 = snapshots.create_version(wide, root, "all")
    tag2 = snapshots.create_version(wide.filter("year < 1997"), root, "early")
    assert tag1 != tag2
    assert [r.tag for r in snapshots.list_versions(spark, root).collect()] == [tag1, tag2]
    snapshots.restore_version(spark, root, tag1, target)
    back = snapshots.restore_version(spark, root, tag2, target)
    assert back.count() == wide.filter("year < 1997").count()
    assert spark.read.parquet(f"{target}_backup").count() == wide.count()
    with pytest.raises(ValueError):
        snapshots.restore_version(spark, root, "none", target)


def test_save_prunes_years(spark, tmp_path, wide):
    snapshots.save_dataset(wide, f"{tmp_path}/data")
    d = snapshots.load_dataset(spark, f"{tmp_path}/data").filter("year = 1996")
    assert d.count() == wide.filter("year = 1996").count()
    assert "PartitionFilters: [isnotnull(year" in d._jdf.queryExecution().toString()
    assert '"rows":' in spark.read.text(f"{tmp_path}/data/metadata").first()[0]


def test_form_stream_of_shuffled_rows_equals_batch(spark, tmp_path, wide):
    """Rows in any order within a year of delay, in four files; a last row far ahead lets
    the watermark pass all others. One row comes too late and is counted."""
    src = f"{tmp_path}/in"
    m = wide.select("row_id", "team", F.col("match_date").cast("timestamp").alias("match_date"), "result", "league", "patch")
    months = F.months_between("match_date", F.lit("1992-01-01")) + F.pmod(F.xxhash64("row_id"), F.lit(11))
    for i in range(4):
        part = F.least(F.greatest(F.floor(months / 24), F.lit(0)), F.lit(3)) == i
        m.filter(part).repartition(1, F.xxhash64("row_id", F.lit(7))).write.mode("append").parquet(f"{src}/part={i}")
    late = "SELECT -2L AS row_id, 'nobody' AS team, TIMESTAMP '1980-01-01' AS match_date, 1 AS result, 'x' AS league, '1.1' AS patch"
    for i, day in enumerate(("2100-01-01", "2100-01-02")):
        ahead = spark.sql(f"SELECT -1L AS row_id, 'nobody' AS team, TIMESTAMP '{day}' AS match_date, 1 AS result, 'x' AS league, '1.1' AS patch UNION ALL {late}" if i else f"SELECT -1L AS row_id, 'nobody' AS team, TIMESTAMP '{day}' AS match_date, 1 AS result, 'x' AS league, '1.1' AS patch")
        ahead.select(*[F.col(c).cast(t).alias(c) for c, t in m.dtypes]).coalesce(1).write.mode("append").parquet(f"{src}/part={4 + i}")
    s = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    progress = jobs.run_available(jobs.form_stream(s, delay="400 days"), f"{tmp_path}/out", f"{tmp_path}/chk")
    assert len(progress) >= 5 and jobs.late_rows(progress) == 1
    cols = ["row_id", "games_played", "overall_winrate", "recent_winrate", "current_streak"]
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect())
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(form.entity_form(m))


def test_sessions_after_a_restart(spark, tmp_path):
    """Two parts with a stop between: closed sessions once each, open ones when read."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [(u, at + timedelta(hours=h)) for u, hs in ((1, (0, 1, 2, 20, 21, 60)), (2, (0, 30, 31, 59, 60))) for h in hs]
    d = spark.createDataFrame(rows, "user_id int, ts timestamp")
    closed_schema = "user_id int, session_start timestamp, last_event timestamp, events long"
    for part, condition in enumerate(("ts < '2024-01-02 07:00:00'", "ts >= '2024-01-02 07:00:00'")):
        d.filter(condition).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # nothing new the second time
            s = jobs.with_event_time(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), "ts", "1 hour")
            jobs.run_available(jobs.sessions(s, ["user_id"], "ts", "6 hours"), f"{tmp_path}/out", f"{tmp_path}/chk")
        seen = d if part else d.filter(condition)
        closed = spark.read.schema(closed_schema).parquet(f"{tmp_path}/out")
        every = closed.unionByName(jobs.open_sessions(seen, closed, ["user_id"], "ts", "6 hours"))
        assert sorted(map(tuple, every.collect())) == sorted(map(tuple, jobs.sessions(seen, ["user_id"], "ts", "6 hours").select(*closed.columns).collect()))
        assert closed.count() > 0


def test_drift_stream_equals_batch(spark, tmp_path):
    xs = [(["a", "b"][i % 2], i, float((i * 7919 % 100) < (20 if i < 300 else 80))) for i in range(600)]
    d = spark.createDataFrame(xs, "model string, i int, v double")
    for n in range(2):
        d.filter(f"i >= {n * 300} AND i < {(n + 1) * 300}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={n}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    jobs.run_available(jobs.drift_stream(s, ["model"], ["i"], "v"), f"{tmp_path}/out", f"{tmp_path}/chk")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("model", "position").collect())
    want = sorted(tuple(r) for r in drift.adaptive_sequence(d, ["model"], ["i"], "v").select("model", "position").collect())
    assert want and got == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (3, "2024-01-01 01:00:00"), (4, "2024-01-03 01:00:00")], "id int, t string")
    d = d.withColumn("ts", F.to_timestamp("t")).drop("t")
    for i in range(1, 5):
        d.filter(f"id = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={i}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    dd = jobs.deduplicated(s, ["id"], "ts", "1 hour")
    progress = jobs.run_available(dd, f"{tmp_path}/out", f"{tmp_path}/chk")
    kept = {r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(kept) + jobs.late_rows(progress) == 4


def test_batches_resolve_to_the_last(spark, tmp_path):
    put = jobs.append_batches(f"{tmp_path}/t")
    d = lambda rows: spark.createDataFrame(rows, "k int, v int")
    put(d([(1, 1), (2, 1)]), 0)
    put(d([(2, 2), (3, 2)]), 1)
    put(d([(2, 2), (3, 2)]), 1)  # the same batch once more
    got = {r.k: r.v for r in jobs.resolved(spark, f"{tmp_path}/t", ["k"], ["v"]).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    first = {r.k: r.v for r in jobs.resolved(spark, f"{tmp_path}/t", ["k"], ["v"], "first").collect()}
    assert first == {1: 1, 2: 1, 3: 2}


@pytest.fixture(scope="module")
def scorer(wide):
    fm = FeatureModel.fit(wide.filter("year < 1998"))
    vec = cut_lineage(fm.vector(wide.filter("year < 1998"), "rows", ["row_id", "result"]))
    return DraftScorer(fm, training.fit_logistic(vec, list(CANONICAL_48)))


def test_draft_scores(spark, sf, scorer):
    d = fx.drafts(spark, sf)
    got = {r.draft_id: r for r in scorer.score(d).collect()}
    assert len(got) == d.count()
    assert all(0 < r.blue_win_prob < 1 and abs(r.blue_win_prob + r.red_win_prob - 1) < 1e-6 for r in got.values())
    assert all(r.lower_bound <= r.blue_win_prob <= r.upper_bound for r in got.values())
    swapped = d.withColumns({"blue_team": F.col("red_team"), "red_team": F.col("blue_team")})
    other = {r.draft_id: r.blue_win_prob for r in scorer.score(swapped).collect()}
    assert any(abs(other[k] - got[k].blue_win_prob) > 1e-6 for k in got)
    assert len({round(r.blue_win_prob, 6) for r in got.values()}) > 10


def test_pick_impact_has_five_roles(spark, sf, scorer):
    d = fx.drafts(spark, sf).filter("draft_id < 40")
    n = scorer.pick_impact(d).groupBy("draft_id", "side").agg(F.countDistinct("role").alias("n")).collect()
    assert n and all(r.n == 5 for r in n)


def test_record_and_promote(spark, sf, tmp_path, wide):
    m = cut_lineage(form.entity_form(wide).select("row_id", "result", "match_date", F.col("overall_winrate"), F.col("recent_winrate")))
    d = splits.temporal_split(m)
    model = training.fit_logistic(d.filter("split = 'train'"), ["overall_winrate", "recent_winrate"])
    metrics = spark.createDataFrame([("auc", 0.70), ("f1", 0.60)], "metric string, value double")
    better = spark.createDataFrame([("auc", 0.71), ("f1", 0.62)], "metric string, value double")
    lifecycle.record_model(model, metrics, str(tmp_path), "v1")
    lifecycle.record_model(model, better, str(tmp_path), "v2")
    h = lifecycle.run_history(spark, str(tmp_path))
    assert lifecycle.promote_if_better(h, "v1", "v2").first().promote
    assert not lifecycle.promote_if_better(h, "v2", "v1").first().promote
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(f"{tmp_path}/models/v1")
    assert training.predict(again, d, ["row_id"]).count() == d.count()


@pytest.mark.parametrize("train, held, verdict", [([0.9, 0.9], [0.55, 0.56], "high_variance"), ([0.82, 0.81], [0.8, 0.8], "well_fitted"), ([0.6, 0.6], [0.6, 0.6], "high_bias"), ([0.8, 0.8], [0.6, 0.72], "not_converged")])
def test_learning_diagnosis(spark, train, held, verdict):
    rows = [(float(i), part, v) for part, vs in (("train", train), ("held", held)) for i, v in enumerate([vs[0], *vs])]
    assert training.diagnose(spark.createDataFrame(rows, "size double, part string, mean_auc double")).first().verdict in (verdict,)


def test_invalid_drafts_are_not_scored(spark, sf, wide, scorer):
    from boutline.operators import lookups

    d = fx.drafts(spark, sf)
    names = lambda a: [F.lit(f"C{i}") for i in range(a, a + 5)]
    full = lambda a: F.map_from_arrays(F.array(*[F.lit(r) for r in ROLES]), F.array(*names(a)))
    # the first half become clean drafts, but for their spoiled team
    half = F.col("draft_id") < 300
    new = {"blue_picks": full(0), "red_picks": full(5), "blue_bans": F.array(*names(10)), "red_bans": F.array(*names(15))}
    d = d.withColumns({c: F.when(half, v).otherwise(F.col(c)) for c, v in new.items()})
    known = lookups.champion_counts(wide).filter("champion <> 'Unknown'")
    scores, errors = scorer.checked(d, known, lookups.team_counts(wide))
    bad = {r.draft_id for r in errors.select("draft_id").distinct().collect()}
    good = {r.draft_id for r in scores.collect()}
    assert bad and good and not bad & good and len(bad | good) == d.count()


def test_joint_fits_equal_single_ones(spark):
    """All folds and penalties in one scan a step: coefficients as by one fit each."""
    import numpy as np

    from boutline.ml import newton

    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4)) * [1, 3, 0.1, 1] + [0, 1, 5, 0]
    x[:, 3] = 0.5  # a constant feature stays out
    y = (r.random(3000) < 1 / (1 + np.exp(-(x @ [1, -0.5, 4, 0] - 20)))).astype(int)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(3000)], "row_id long, result int, a double, b double, c double, d double")
    subsets = {str(k): (F.col("row_id") % 3 != k, F.col("row_id") % 3 == k) for k in range(3)} | {"none": (F.lit(False), F.lit(True))}
    fits = [newton.Fit(f"{k}-{c}-{a}", k, c, a) for k in ("0", "1") for c in (0.001, 1.0) for a in (0.0, 0.6)] + [newton.Fit("none", "none")]
    rows = newton.design(df, names, subsets, keep=["row_id"])
    got = newton.fit_many(rows, names, list(subsets), fits)
    assert got.gradient.max() < 1e-8 and not got.coefficients[-1].any()
    for i in (0, 1, 7):
        f = fits[i]
        one = training.fit_logistic(df.filter(subsets[f.subset][0]), names, f.c, f.l1_share).stages[-1]
        assert np.allclose(got.coefficients[i] * got.deviations[i], one.coefficients.toArray(), atol=1e-3)
    worst = newton.optimality(rows, newton.fit_many(rows, names, list(subsets), fits[:2]), list(subsets)).agg(F.max(F.abs("gradient"))).first()[0]
    assert worst < 1e-8
    from boutline.evaluation import metrics as M

    exact = {(x.fit, x.part): x for x in M.report(newton.scores(rows, got, list(subsets)), ["fit", "part"]).collect()}
    for m in newton.held_metrics(rows, got, list(subsets)).filter("fit <> 'none'").collect():
        e = exact[m.fit, m.part]
        assert m.rows == e.rows and abs(m.auc - e.auc) < 1e-3 and abs(m.log_loss - e.log_loss) < 1e-9 and abs(m.f1 - e.f1) < 1e-9 and abs(m.accuracy - e.accuracy) < 1e-9


def test_cell_bootstrap_in_slots(spark, sf):
    """Slots of any size give the same replicates, close to drawing rows one by one."""
    import numpy as np

    from boutline.evaluation import bootstrap as B

    p = fx.predictions_long(spark, sf)
    whole, parts = ({(x.model, x.replicate): (x.accuracy, x.f1, x.auc) for x in B.bootstrap(p, ["model"], 60, n).collect()} for n in (4096, 7))
    assert whole.keys() == parts.keys() and all(np.allclose(whole[k], parts[k], atol=1e-12) for k in whole)
    table = np.array([(x.y_true, x.p) for x in p.filter("model = 'a'").collect()])
    r = np.random.default_rng(1)
    acc = [((s[:, 1] >= 0.5) == s[:, 0]).mean() for s in (table[r.integers(0, len(table), len(table))] for _ in range(60))]
    own = [v[0] for k, v in whole.items() if k[0] == "a"]
    assert abs(np.mean(own) - np.mean(acc)) < 4 * np.std(acc) / 60**0.5 * 2 and 0.6 < np.std(own) / np.std(acc) < 1.7


def test_p_values_of_results(spark, sf):
    from boutline.evaluation import metrics as M

    r = M.with_p_value(M.mcnemar(fx.predictions(spark, sf), "p_a", "p_b"), "statistic", []).first()
    assert 0 <= r.p_value <= 1


def test_drift_window_forgets_nothing():
    """A shift after a long quiet stretch is found, in one go or point by point, and
    memory follows the logarithm of the window."""
    from boutline.evaluation.drift import DyadicWindow

    series = [1.0] * 3000 + [0.7] * 400
    whole = DyadicWindow().feed(series)
    scan, parts = DyadicWindow(), []
    for i in range(0, len(series), 7):
        parts += scan.feed(series[i : i + 7])
        scan = DyadicWindow(0.002, 30, 32, *scan.state())  # as a stream restores it
    assert whole == parts and 2990 <= whole[0][0] <= 3010
    short = [1.0] * 28 + [0.0] * 28
    scan = DyadicWindow()
    assert DyadicWindow().feed(short) == [] == [x for v in short for x in scan.feed([v])]
    quiet = DyadicWindow()
    quiet.feed([0.5] * 20_000)
    assert len(quiet.borders) < 32 * 12 and quiet.seen == 20_000
    # with every border kept, cuts are those of the exhaustive search
    exact = DyadicWindow(exact=10_000)
    near = exact.feed(series)
    assert abs(near[0][0] - whole[0][0]) <= 64 and len(exact.borders) > len(scan.borders)


def test_progress_of_many_batches(spark, tmp_path):
    from boutline.streaming import jobs

    src = f"{tmp_path}/in"
    spark.range(120).selectExpr("id", "timestamp_seconds(id * 60) AS ts").repartition(120, "id").write.parquet(src)
    s = jobs.with_event_time(spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src), "ts", "1 minute")
    n = len([f for f in __import__("os").listdir(src) if f.endswith(".parquet")])
    progress = jobs.run_available(s, f"{tmp_path}/out", f"{tmp_path}/chk")
    assert sum(p["numInputRows"] for p in progress) == 120 and len(progress) >= n


def test_all_extra_columns_are_told(spark):
    from boutline.operators import schema

    d = spark.createDataFrame([tuple(range(12))], ", ".join(f"c{i} int" for i in range(12)))
    assert schema.validate_schema(d).filter("kind = 'extra_column'").count() == 12


def test_load_in_parts_equals_full_load(spark, sf, tmp_path):
    """The same files, at once or in parts, give the same rows under a minimum of games."""
    from boutline.sources import csv_matches

    p = fx.player_rows(spark, sf).select(
        F.concat(F.col("year").cast("string"), F.lit("_match_data")).alias("file"), "gameid", "league", F.date_format("match_date", "yyyy-MM-dd").alias("date"), "patch", F.col("split_name").alias("split"),
        F.concat_ws("@", "team", F.col("row_id") % 2).alias("teamname"), "side", "result", "champion", "position", "playername",
    )
    p.write.partitionBy("file").option("header", True).csv(f"{tmp_path}/by_year")
    leagues = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    every = f"{tmp_path}/by_year/file=*_match_data*"
    csv_matches.full_load(spark, every, f"{tmp_path}/one", leagues, min_games=11)
    csv_matches.full_load(spark, f"{tmp_path}/by_year/file=199[0-7]_match_data*", f"{tmp_path}/two", leagues, min_games=11)
    added = csv_matches.incremental_load(spark, every, f"{tmp_path}/two", leagues, min_games=11)
    got = [sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{x}/data").select("gameid", "side", "team").collect())) for x in ("one", "two")]
    assert added > 0 and got[0] == got[1]


def test_validation_curve_has_every_point(spark, sf):
    """C goes down to 1e-06, whose name holds a dash."""
    from boutline.catalog import QUERIES

    rows = QUERIES["p12_validation_curve"](spark, sf).collect()
    assert sorted({r["c"] for r in rows}) == [10.0**e for e in range(-6, 4)]
    assert len(rows) == 20 and all(r["folds"] == 5 and 0 <= r["mean_auc"] <= 1 for r in rows)


def test_form_state_is_kept_by_slots(spark, tmp_path):
    """Many entities, one of them null, share a few timers and state values, however many they are."""
    rows = [(i, None if i % 301 == 0 else i * 7919 % 300 + 2**60, (i * 13 % 7 < 3), 5 * i - (i * 31 % 900)) for i in range(1, 3000)]
    d = spark.createDataFrame(rows, "row_id long, team long, won boolean, minute long").select("row_id", "team", F.col("won").cast("int").alias("result"), F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("match_date"))
    progress = []
    for lo, hi in ((0, 1000), (1000, 2000), (2000, 3000)):
        d.filter(f"row_id >= {lo} AND row_id < {hi}").write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
        progress += jobs.run_available(jobs.form_stream(s, delay="16 hours", slots=8), f"{tmp_path}/out", f"{tmp_path}/chk")
    assert jobs.late_rows(progress) == 0 and 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress) < 300
    want, past = {}, {}
    for row, team, won, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        ys = past.setdefault(team, [])
        want[row] = (team, len(ys), sum(ys) / len(ys) if ys else 0.5, sum(ys[-10:]) / len(ys[-10:]) if ys else 0.5)
        ys.append(int(won))
    ahead = max(r[3] for r in rows) - 16 * 60
    got = {r.row_id: (r.team, r.games_played, r.overall_winrate, r.recent_winrate) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r[0]: want[r[0]] for r in rows if r[3] < ahead}


def test_swaps_of_both_sides_are_one_batch(spark, sf, scorer, monkeypatch):
    """Each side's draft and its swaps are scored together, dealt over tasks before the lookups."""
    from boutline import fixtures as fx
    from boutline.operators import lookups

    seen, own = [], scorer.score_rows
    monkeypatch.setattr(scorer, "score_rows", lambda rows, keep, also=(): seen.append(rows) or own(rows, keep, also))
    d = fx.drafts(spark, sf).limit(20).localCheckpoint()
    scorer.both_suggestions(d, lookups.meta_indicators(fx.wide(spark, sf)))
    assert len(seen) == 1
    rows = seen[0]
    assert rows.groupBy("draft_id", "side").count().filter("count <> 26").count() == 0 and rows.select("row_id").distinct().count() == 20 * 2 * 26
    assert "RepartitionByExpression [draft_id" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_series_of_a_drift_stream_share_slots(spark, tmp_path):
    """Many series in few calls: a call costs the same whatever it carries. Keys of other
    types than text, null among them, come back as they were."""
    xs = [(i % 40 if i % 40 else None, i, float(i * 7919 % 100 < (20 if i < 6000 else 80))) for i in range(12000)]
    d = spark.createDataFrame(xs, "k int, i int, v double")
    for n in range(3):
        d.filter(f"i >= {n * 4000} AND i < {(n + 1) * 4000}").coalesce(1).write.parquet(f"{tmp_path}/in/p={n}")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    progress = jobs.run_available(jobs.drift_stream(s, ["k"], ["i"], "v", slots=2), f"{tmp_path}/out", f"{tmp_path}/chk")
    assert max(int(o["numRowsTotal"]) for p in progress for o in p["stateOperators"]) <= 2  # a state row a slot, not a series
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=key)
    want = sorted((tuple(r) for r in drift.adaptive_sequence(d, ["k"], ["i"], "v").collect()), key=key)
    assert got == want and len({r[0] for r in got}) > 30


def test_window_judges_points_together():
    """A stretch of points shares a bound; one by one they would take some 90 numpy calls each."""
    from unittest import mock

    from boutline.evaluation.drift import DyadicWindow

    series = [float(i * 7919 % 100 < 70) for i in range(20_000)]
    with mock.patch.object(DyadicWindow, "_gaps", autospec=True, side_effect=DyadicWindow._gaps) as judged:
        found = DyadicWindow().feed(series)
    assert judged.call_count < len(series) / 50
    one, window = [], DyadicWindow()
    for v in series:
        one += window.feed([v])
    assert found == one
