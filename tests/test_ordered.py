"""The split (hot key) way must give what plain windows give."""

import random

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.operators import form
from boutline.plans import ordered


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def toy(spark, n=400, seed=3):
    rnd = random.Random(seed)
    data = [(i, ["hot", "hot", "hot", "x", "y"][rnd.randrange(5)], rnd.randrange(30), rnd.randrange(2)) for i in range(n)]
    d = spark.createDataFrame(data, "row_id long, team string, day int, result int")
    return d.withColumn("match_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")))


def test_rank_is_a_global_order(spark):
    d = toy(spark)
    got = ordered.ranked(d, [], ordered.time_levels(d, "match_date", "row_id", 64), ["match_date", "row_id"]).collect()
    want = sorted(got, key=lambda r: (r.match_date, r.row_id))
    assert [r._rank for r in want] == list(range(len(want)))


def test_running_both_ways(spark):
    d = toy(spark)
    got = ordered.running(d, ["team"], ordered.time_levels(d, "match_date", "row_id", 64), ["match_date", "row_id"],
                          {"after": ("sum", F.col("result"))}, descending=True).collect()
    for r in got:
        later = [s.result for s in got if s.team == r.team and (s.match_date, s.row_id) > (r.match_date, r.row_id)]
        assert r.after == sum(later)


def test_split_history_equals_plain(spark):
    d = toy(spark)
    y = F.col("result")
    pasts = [ordered.Past(["team"], "n", totals={"w": ("sum", y)}, late={"lw": ("max", F.when(y == 1, F.col("n")))},
                          frames={"a3": (F.avg, y, 3), "s10": (F.stddev_samp, y, 10)})]
    levels = ordered.time_levels(d, "match_date", "row_id", 64)
    args = (d, ["team"], pasts, ["match_date", "row_id"], levels)
    plain = ordered.history(*args, hot_rows=None)
    for block in (10, 17, 1000):
        split = ordered.history(*args, hot_rows=100, block_rows=block)
        assert rows(split.select(*plain.columns)) == rows(plain)


def test_entity_form_split_equals_plain(spark, sf):
    m = fx.matches(spark, sf).select("row_id", "match_date", "team", "league", "patch", "result")
    plain = form.entity_form(m, hot_rows=None)
    split = form.entity_form(m, hot_rows=70)
    assert rows(split.select(*plain.columns)) == rows(plain)


def test_quantiles_are_exact(spark):
    import numpy as np

    rnd = random.Random(5)
    vals = [rnd.choice([rnd.gauss(0, 5), 1.25, -3.5, 1e6]) for _ in range(501)]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    got = ordered.quantiles(d, [], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.975}).first()
    assert np.allclose([got.q1, got.q2, got.q3], np.quantile(vals, [0.25, 0.5, 0.975]))


def test_timestamps_and_sparse_ids(spark):
    """Order within a day is by moment, whatever the ids; both ways agree."""
    data = [("a", f"2024-01-0{1 + i // 40} {i % 24:02d}:{(i * 7) % 60:02d}:00", (i * 2654435761) % (1 << 40), i % 3 % 2) for i in range(90)]
    data += [("a", "2024-02-01 10:00:00", 2097152, 1), ("a", "2024-02-01 12:00:00", 5, 0), ("a", "2024-02-01 15:00:00", 9, 1)]
    d = spark.createDataFrame(data, "team string, t string, row_id long, y int").withColumn("t", F.col("t").cast("timestamp"))
    want = {r: i for i, (_, r) in enumerate(sorted((t, r) for _, t, r, _ in data))}
    levels = ordered.time_levels(d, "t", "row_id")
    got = ordered.ranked(d, [], levels, ["t", "row_id"]).collect()
    assert {r.row_id: r._rank for r in got} == want
    pasts = [ordered.Past(["team"], "n", totals={"w": ("sum", F.col("y"))})]
    plain = ordered.history(d, ["team"], pasts, ["t", "row_id"], levels, hot_rows=None)
    split = ordered.history(d, ["team"], pasts, ["t", "row_id"], levels, hot_rows=1)
    assert rows(split.select(*plain.columns)) == rows(plain)


def test_value_slots_stay_small(spark):
    """A million scores in a narrow range fall in many slots, in order."""
    for expr in ("id * 1e-12 + 1e-6", "1.7e9 + id * 1e-3", "-1.7e9 - id * 1e-3", "id * 5e-324"):
        d = spark.range(1_000_000).selectExpr(f"{expr} AS v")
        levels = [c.alias(f"l{i}") for i, c in enumerate(ordered.value_levels("v"))]
        slots = d.select("v", *levels).groupBy("l0", "l1", "l2").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        top = slots.agg(F.max("n")).first()[0]
        assert top <= (1 << 21 if "e-324" in expr else 5_000)
        s = slots.orderBy("l0", "l1", "l2").limit(3000).collect()
        assert all(a.hi < b.lo for a, b in zip(s, s[1:]))
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (0.0,), (1.0,), (-1.0,)], "v double")
    got = [r.v for r in odd.select("v", *[c.alias(f"l{i}") for i, c in enumerate(ordered.value_levels("v"))]).orderBy("l0", "l1", "l2").collect()]
    assert got[:5] == [float("-inf"), -1.0, 0.0, 1.0, float("inf")]


def test_nearest_in_time_uses_hours(spark):
    from boutline.operators import quality
    from boutline.roles import Roles

    d = spark.createDataFrame([("2024-01-01 00:30:00", 1, "A"), ("2024-01-01 22:00:00", 2, None), ("2024-01-01 23:00:00", 3, "B")], "match_date string, row_id long, x string")
    d = d.withColumn("match_date", F.col("match_date").cast("timestamp"))
    assert {r.row_id: r.x for r in quality.nearest_in_time(d, "x", Roles()).collect()}[2] == "B"


def test_history_is_dealt_by_rows(spark, monkeypatch):
    """More rows than the session's partitions would hold: tasks are added, rows are the same."""
    from boutline.plans import ordered as o

    d = spark.range(3000).selectExpr("id", "id % 40 as k", "date_add(date'2020-01-01', cast(id % 17 as int)) as day", "id % 3 as v")
    past = [o.Past(["k"], "n", totals={"s": ("sum", F.col("v"))})]
    run = lambda: o.history(d, ["k"], past, ["day", "id"], o.time_levels(d, "day", "id"))
    plain = sorted(run().collect())
    monkeypatch.setattr(o, "TASK_ROWS", 20)
    more = run()
    assert more.rdd.getNumPartitions() == 150 and sorted(more.collect()) == plain


def test_values_get_no_more_slot_levels_than_they_need(spark):
    d = spark.range(3000).selectExpr("0 AS k", "0.5 + id / 10000.0D AS v")
    near = spark.range(3000).selectExpr("0 AS k", "0.5 + id / 1e12D AS v")
    assert [len(ordered.value_slots(d, ["k"], "v", n)) for n in (3000, 100)] == [1, 2]
    assert len(ordered.value_slots(near, ["k"], "v", 100)) == 3
    assert len(ordered.value_slots(d.filter("v > 9"), ["k"], "v")) == 1
    for rows in (d, near):
        for n in (3000, 100):
            got = ordered.ranked(rows, ["k"], ordered.value_slots(rows, ["k"], "v", n), ["v"]).orderBy("v").collect()
            assert [r["_rank"] for r in got] == list(range(3000))


def test_tags_by_border_rows_are_those_of_the_ranks(spark):
    from boutline.operators import splits

    d = toy(spark, 700).withColumn("year", F.year("match_date") + (F.col("row_id") % 5 == 0).cast("int") * 3 + (F.col("row_id") > 694).cast("int"))
    few = d.groupBy("year").count().filter("count < 10").count()
    assert few == 2  # years that are left out
    for name, r in splits.PRESETS.items():
        for ranks, tags in (
            (splits.temporal_split(d, *r[:2]), splits.temporal_tags(d, {name: r})),
            (splits.stratified_temporal_split(d, *r[:2]), splits.temporal_tags(d, {name: r}, ["year"], 10)),
            (splits.stratified_random_split(d, *r[:2]), splits.random_tags(d, {name: r})),
        ):
            assert tags.columns == [*d.columns, name] and tags.count() == 700
            assert rows(ranks.select("row_id", "split")) == rows(tags.filter(F.col(f"`{name}`").isNotNull()).select("row_id", f"`{name}`"))
            moved = tags._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in moved and "hashpartitioning" not in moved
    assert {r[0] for r in splits.temporal_tags(d.limit(1), {"s": (0.0, 0.0)}).select("s").collect()} == {"test"}
    assert {r[0] for r in splits.temporal_tags(d, {"s": (0.5, 0.5)}).select("s").collect()} == {"train", "val"}
