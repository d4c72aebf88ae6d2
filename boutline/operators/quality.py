"""Data quality, outliers, leakage and description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.evaluation.drift import features_long
from boutline.evaluation.metrics import auc
from boutline.operators.form import role_long
from boutline.plans.ordered import quantiles, running, time_levels
from boutline.roles import MATCH, Roles


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls, null_pct), one pass."""
    agg = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return agg.select("__n", F.explode(items).alias("x")).select("x.*", (F.col("x.nulls") / F.col("__n") * 100).alias("null_pct"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every group of equal rows. Copies meet map-side."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    """(feature, lower, upper) for all columns in one job; exact quartiles."""
    long = features_long(df, columns, [])
    if method == "iqr":
        q = quantiles(long, ["feature"], "value", {"q1": 0.25, "q3": 0.75})
        w = (F.col("q3") - F.col("q1")) * k
        return q.select("feature", (F.col("q1") - w).alias("lower"), (F.col("q3") + w).alias("upper"))
    if method == "zscore":
        g = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).filter("s > 0")
        return g.select("feature", (F.col("m") - F.col("s") * k).alias("lower"), (F.col("m") + F.col("s") * k).alias("upper"))
    raise ValueError(f"unknown method {method}")


def flag_outliers(df: DataFrame, bounds: DataFrame, columns: list[str], name: str = "is_outlier") -> DataFrame:
    """OR over the columns. The bounds (one row per column) come as one map."""
    m = bounds.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower", "upper"))))).scalar()
    out = df.withColumn("__b", m)

    def beyond(c):
        b = F.element_at(F.col("__b"), c)
        return F.coalesce((F.col(c) < b["lower"]) | (F.col(c) > b["upper"]), F.lit(False))

    return out.withColumn(name, reduce(lambda a, b: a | b, [beyond(c) for c in columns])).drop("__b")


def quality_report(df: DataFrame, required: list[str], numeric: list[str], year: str = "year") -> DataFrame:
    """One row: rows, null share, duplicate share, outlier share and the score
    100 - 5 per missing column - min(null %, 20) - min(dup %, 10) - min(50*outliers, 10)."""
    missing = len([c for c in required if c not in df.columns])
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    base = df.agg(F.count("*").alias("rows"), (nulls / (F.count("*") * len(df.columns)) * 100).alias("null_pct"))
    dup = duplicate_count(df).scalar()
    flagged = flag_outliers(df, outlier_bounds(df, numeric), numeric).agg(F.avg(F.col("is_outlier").cast("double"))).scalar()
    out = base.withColumns({"missing_columns": F.lit(missing), "duplicate_pct": dup / F.col("rows") * 100, "outlier_share": flagged})
    score = (
        100 - F.lit(5.0) * F.col("missing_columns") - F.least(F.col("null_pct"), F.lit(20.0)) - F.least(F.col("duplicate_pct"), F.lit(10.0))
        - F.least(F.col("outlier_share") * 50, F.lit(10.0))
    )
    return out.withColumn("score", F.greatest(score, F.lit(0.0)))


def temporal_integrity(df: DataFrame, now: Column, roles: Roles = MATCH, max_gap: int = 365) -> DataFrame:
    """Rows in the future, range, longest gap between consecutive dates and gaps
    over the limit. Rows are reduced to distinct dates first."""
    t = F.to_date(roles.time)
    days = df.groupBy(t.alias("d")).agg(F.count("*").alias("n"))
    gap = F.datediff("d", F.lag("d").over(Window.orderBy("d")))
    g = days.select("d", "n", F.coalesce(gap, F.lit(0)).alias("gap"))
    return g.agg(
        F.sum(F.when(F.col("d") > now, F.col("n")).otherwise(0)).alias("future_rows"), F.min("d").alias("first_date"), F.max("d").alias("last_date"),
        F.max("gap").alias("longest_gap"), F.count_if(F.col("gap") > max_gap).alias("long_gaps"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Baseline of features: count, mean, std, min, quartiles, max per feature."""
    long = features_long(df, columns, [])
    s = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return s.join(quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "feature")


def leakage_findings(df: DataFrame, roles: Roles = MATCH, few: int = 10) -> DataFrame:
    """(kind, name, value): entities with extreme rates or few games, champions with
    extreme rates per role."""
    t = df.groupBy(roles.entity).agg(F.count(roles.outcome).alias("n"), (F.sum(roles.outcome) / F.count(roles.outcome)).alias("m"))
    kind = F.when(F.col("m") > 0.7, "high_rate_team").when(F.col("m") < 0.3, "low_rate_team")
    teams = t.select(
        F.col(roles.entity).alias("name"), "m",
        F.explode(F.filter(F.array(kind, F.when(F.col("n") < few, F.lit("small_sample_team"))), lambda x: x.isNotNull())).alias("kind"),
    ).select("kind", "name", F.col("m").alias("value"))
    c = role_long(df, roles, [roles.outcome]).groupBy("role", "champion").agg((F.sum(roles.outcome) / F.count(roles.outcome)).alias("m"))
    ck = F.when(F.col("m") > 0.8, "high_rate_champion").when(F.col("m") < 0.2, "low_rate_champion")
    champs = c.select(ck.alias("kind"), F.concat_ws(":", "role", "champion").alias("name"), F.col("m").alias("value")).filter("kind IS NOT NULL")
    return teams.unionByName(champs)


def encoding_drift(df: DataFrame, column: str, n: int = 1000, limit: float = 0.05, roles: Roles = MATCH) -> DataFrame:
    """Mean of an encoding over the first and the last n rows of the order."""
    order = [F.col(roles.time), F.col(roles.row)]
    first = df.orderBy(*order).limit(n).agg(F.avg(column).alias("first_mean"))
    last = df.orderBy(*[c.desc() for c in order]).limit(n).agg(F.avg(column)).scalar()
    out = first.withColumn("last_mean", last)
    d = F.abs(F.col("first_mean") - F.col("last_mean"))
    return out.withColumns({"difference": d, "drifts": d > limit})


def single_feature_auc(df: DataFrame, features: list[str], roles: Roles = MATCH, limit: float = 0.85) -> DataFrame:
    """AUC of every feature on its own, all features in one job."""
    long = features_long(df, features, [roles.outcome]).select("feature", F.col(roles.outcome).alias("y_true"), F.col("value").alias("p"))
    a = auc(long, ["feature"])
    return a.withColumn("suspicious", (F.col("auc") > limit) | (F.col("auc") < 1 - limit))


def nearest_in_time(df: DataFrame, column: str, roles: Roles = MATCH) -> DataFrame:
    """Missing values take the value of the row nearest in time, the earlier one on
    a tie. The last known before and the first known after each row are prefix
    extremes over slots of the order; no task sorts all rows."""
    order = [roles.time, roles.row]
    levels = time_levels(df, roles.time, roles.row)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(roles.time).alias("t"), F.col(roles.row).alias("r"), F.col(column).alias("v")))
    d = running(df, [], levels, order, {"__b": ("max", known)})
    d = running(d, [], levels, order, {"__a": ("min", known)}, descending=True, source=df)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    before, after = at(roles.time) - at("__b.t"), at("__a.t") - at(roles.time)
    pick = F.when(F.col("__a.t").isNull() | (before <= after), F.col("__b.v")).otherwise(F.col("__a.v"))
    return d.withColumn(column, F.coalesce(F.col(column), pick)).drop("__b", "__a")
