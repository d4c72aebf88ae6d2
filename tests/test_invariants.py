"""Properties that must hold whatever the data."""

import math

import pytest
from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.evaluation import drift
from boutline.evaluation import metrics as M
from boutline.functions import scalar
from boutline.operators import drafts, form, lookups, quality, setops, splits
from boutline.operators.features import CANONICAL_48, FeatureModel, role_lookup


def key(df, cols, k="row_id"):
    return {r[k]: tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()}


FEATS = ["games_played", "overall_winrate", "recent_winrate", "performance_volatility", "current_streak", "patch_performance", "league_recent"]


def test_no_leak(spark, sf):
    """Flipping one outcome changes no feature of that row or of earlier rows."""
    m = fx.matches(spark, sf)
    row = m.orderBy("match_date", "row_id").collect()[700]
    flipped = m.withColumn("result", F.when(F.col("row_id") == row.row_id, 1 - F.col("result")).otherwise(F.col("result")))
    a, b = key(form.entity_form(m), FEATS), key(form.entity_form(flipped), FEATS)
    order = {r.row_id: (r.match_date, r.row_id, r.team) for r in m.collect()}
    changed = [r for r in a if a[r] != b[r]]
    assert changed
    at = order[row.row_id]
    assert all(order[r][2] == row.team and order[r][:2] > at[:2] for r in changed)


@pytest.mark.parametrize("split", ["temporal_split", "stratified_temporal_split", "stratified_random_split"])
def test_splits_cover_once(spark, sf, split):
    m = fx.matches(spark, sf)
    d = getattr(splits, split)(m).groupBy("row_id").agg(F.count("*").alias("n"), F.first("split").alias("s")).collect()
    assert len(d) == m.count() and all(r.n == 1 for r in d) and {r.s for r in d} == {"train", "val", "test"}


def test_folds_hold_out_by_time(spark, sf):
    m = fx.matches(spark, sf)
    f = splits.expanding_folds(m).join(m.select("row_id", "match_date"), "row_id")
    r = f.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("match_date"))).alias("a"), F.min(F.when(F.col("role") == "val", F.col("match_date"))).alias("b")).collect()
    assert len(r) == 6 and all(x.a <= x.b for x in r)


def test_shuffle_partitions_do_not_matter(spark, sf):
    m = fx.matches(spark, sf)
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append((key(form.entity_form(m), FEATS), key(splits.temporal_split(m), ["split", "_rank"]), key(splits.stratified_random_split(m), ["split"])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]


def test_metric_identities(spark, sf):
    p = fx.predictions_long(spark, sf)
    flip = p.withColumn("p", 1 - F.col("p"))
    a, b = M.auc(p, ["model"]).orderBy("model").collect(), M.auc(flip, ["model"]).orderBy("model").collect()
    assert all(abs(x.auc + y.auc - 1) < 1e-9 for x, y in zip(a, b))
    assert all(r.ece <= r.mce + 1e-12 for r in M.calibration_error(p, ["model"]).collect())
    rep = {r.model: r for r in M.report(p, ["model"]).collect()}
    conf = {r.model: r for r in M.confusion_metrics(p, ["model"]).collect()}
    ll = {r.model: r for r in M.log_loss_brier(p, ["model"]).collect()}
    for m in ("a", "b"):
        assert abs(rep[m].mcc - conf[m].mcc) < 1e-9 and abs(rep[m].log_loss - ll[m].log_loss) < 1e-9
        assert abs(rep[m].auc - [x.auc for x in a if x.model == m][0]) < 1e-9


def test_no_drift_against_itself(spark, sf):
    v = fx.table(spark, sf, "events").select("value")
    both = v.withColumn("is_current", F.lit(False)).unionByName(v.withColumn("is_current", F.lit(True))).withColumn("feature", F.lit("v"))
    assert abs(drift.psi(both, ["feature"]).first().psi) < 1e-12
    assert drift.ks_statistic(both, ["feature"]).first().ks < 1e-12


def test_mirror_sums_to_one(spark, sf):
    m = fx.matches(spark, sf)
    r = setops.mirror(m).groupBy("row_id").agg(F.sum("result").alias("s"), F.countDistinct("side").alias("n")).filter("s <> 1 OR n <> 2")
    assert r.isEmpty()


def test_drafts_equal_rows(spark, sf):
    """The draft form of a game has the features of its rows, exactly."""
    w = fx.wide(spark, sf)
    fm = FeatureModel.fit(w.filter("year < 1998"))
    d = fx.drafts(spark, sf).filter("draft_id % 26 <> 0 AND draft_id % 22 <> 0 AND draft_id % 34 <> 0")
    got = key(fm.vector(drafts.side_rows(d), "snapshot"), CANONICAL_48)
    # drafts take league and split from the blue side
    g = w.filter("side = 'Blue'").select("gameid", F.col("league").alias("l"), F.col("split_name").alias("s"))
    rows = w.join(g, "gameid").withColumns({"league": F.col("l"), "split_name": F.col("s")})
    rows = rows.withColumn("row_id", F.col("gameid") * 2 + (F.col("side") == "Red").cast("int"))
    want = key(fm.vector(rows, "snapshot"), CANONICAL_48)
    assert got and all(got[k] == want[k] for k in got)


def test_large_lookup_is_joined_by_shuffle(spark, sf):
    w = fx.wide(spark, sf)
    lk = lookups.meta_indicators(w).select("patch", "champion", "meta_strength")
    cols = [f"meta_strength_{i}" for i in range(5)]
    small = key(role_lookup(w, lk, ["patch"], {"meta_strength": 0.5}), cols)
    large = key(role_lookup(w, lk, ["patch"], {"meta_strength": 0.5}, max_rows=0), cols)
    assert small == large


def test_split_ways_of_samples_and_windows(spark, sf):
    m = fx.matches(spark, sf)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(splits.temporal_samples(m, hot_rows=None)) == rows(splits.temporal_samples(m, hot_rows=40))
    p = fx.predictions_long(spark, sf).withColumn("ok", ((F.col("p") >= 0.5).cast("int") == F.col("y_true")).cast("double"))
    lv = [F.to_date("ts"), F.hour("ts")]
    a = drift.sliding_drift(p, ["model"], lv, ["ts", "event_id"], "ok", hot_rows=None)
    b = drift.sliding_drift(p, ["model"], lv, ["ts", "event_id"], "ok", hot_rows=100)
    assert rows(a) == rows(b.select(*a.columns))


def test_greedy_suggestions_by_brute_force(spark, sf):
    from boutline.catalog.drafts import _gains

    g = _gains(spark, sf).select("draft_id", "role", "champion", "gain")
    got = {}
    for r in drafts.resolve_suggestions(g).orderBy("draft_id", "place").collect():
        got.setdefault(r.draft_id, []).append((r.role, r.champion))
    want = {}
    per = {}
    for r in g.collect():
        per.setdefault(r.draft_id, []).append(r)
    for d, rs in per.items():
        out = []
        for r in sorted(rs, key=lambda r: (-r.gain, r.role, r.champion)):
            if r.gain >= 0.5 and len(out) < 5 and all(r.role != a and r.champion != b for a, b in out):
                out.append((r.role, r.champion))
        if out:
            want[d] = out
    assert got == want


def test_adaptive_sequence_by_brute_force(spark):
    import random

    rnd = random.Random(1)
    xs = [float(rnd.random() < (0.2 if i < 150 else 0.8)) for i in range(300)]

    def cut(w, ln):
        n, mean = len(w), sum(w) / len(w)
        var = sum((x - mean) ** 2 for x in w) / n + 1e-10
        best, size = None, 0.0
        for c in range(5, n - 5):
            d = abs(sum(w[:c]) / c - sum(w[c:]) / (n - c))
            m = c * (n - c) / n
            if d > math.sqrt(2 / m * var * ln) + 2 / (3 * m) * ln and d > size:
                best, size = c, d
        return best

    want, start, ln = [], 0, math.log(2 / 0.002)
    for i in range(30, len(xs)):
        w = xs[start : i + 1]
        c = cut(w, ln) if len(w) >= 10 else None
        if c is not None:
            want.append((start + c, len(w)))
            start += c + 1
    d = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    got = [(r.position, r.window_size) for r in drift.adaptive_sequence(d, ["k"], ["i"], "x", exact=10_000).orderBy("position").collect()]
    assert want and got == want


@pytest.mark.parametrize("common", [None, "team of "])
def test_name_resolution_by_brute_force(spark, common, monkeypatch):
    """Short names, and long ones that begin alike, whose common pieces are not indexed."""
    from boutline.operators import drafts
    from boutline.operators.drafts import resolve_names

    import itertools
    import random

    rnd = random.Random(2)
    known = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(60)})
    asked = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))) for _ in range(60)} - set(known))
    if common:
        monkeypatch.setattr(drafts, "COMMON_PIECE", 5)
        known = [common + n + rnd.choice(["", " united", " city"]) for n in known]
        changed = []
        for n in known:
            i = rnd.randrange(len(n))
            changed.append(n[:i] + rnd.choice(["", "x", "ab"]) + n[i + rnd.randrange(2) :])
        asked = sorted({*changed, "team oaf " + known[0][8:], "tem of " + known[1][8:]} - set(known))

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    got = {}
    res = resolve_names(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(n,) for n in known], "name string"), top=1000)
    for r in res.filter("how = 'suggested'").collect():
        got.setdefault(r.query, set()).add((r.suggestion, r.edit_distance))
    want = {}
    for q, n in itertools.product(asked, known):
        if dist(q, n) <= 2:
            want.setdefault(q, set()).add((n, dist(q, n)))
    assert got == want


def test_p_values():
    assert abs(scalar.chi2_1_sf(3.841458820694124) - 0.05) < 1e-9
    assert abs(scalar.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(scalar.t_two_sided(12.706204736432095, 1) - 0.05) < 1e-9
    assert scalar.ks_sf(0.0, 10, 10) == 1.0 and scalar.ks_sf(0.9, 100, 100) < 1e-6
    assert drift.trend(-0.01, -5.0, 20)[1] == "declining" and drift.trend(0.01, 0.1, 20)[1] == "stable"


def test_nulls_keep_their_rows(spark, sf):
    """A row without a date is ranked first, not lost."""
    m = fx.matches(spark, sf).withColumn("match_date", F.when(F.col("row_id") % 50 != 0, F.col("match_date")))
    d = splits.time_rank(m, [])
    assert d.count() == m.count()
    assert d.filter("match_date IS NULL").agg(F.max("_rank")).first()[0] == m.filter("match_date IS NULL").count() - 1


def test_outliers_and_quality_score(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    r = quality.quality_report(li, ["l_quantity"], ["l_quantity", "l_extendedprice"]).first()
    assert 0 <= r.score <= 100 and r.rows == li.count()


def test_hot_latest_form_equals_plain(spark, sf):
    m = fx.matches(spark, sf)
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert rows(form.latest_form(m, hot_rows=None)) == rows(form.latest_form(m, hot_rows=70))


def test_hot_players_equal_plain(spark, sf):
    w = fx.wide(spark, sf)
    cols = ["team_avg_player_winrate", "team_avg_player_recent", "team_avg_champion_mastery", "team_player_form"]
    assert key(form.player_features(w, hot_rows=None), cols) == key(form.player_features(w, hot_rows=25), cols)
