"""Outcome encodings of categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.plans.bounded import bounded
from boutline.roles import MATCH, Roles
from boutline.session import cut_lineage


def leave_one_out(df: DataFrame, key: str, roles: Roles = MATCH, name: str | None = None) -> DataFrame:
    """(sum - y) / (n - 1) of the row's category; the global mean if it is alone.

    Sums per category are aggregated and joined back, so a hot category needs no
    window; the global mean is a roll-up of the same sums.
    """
    y = F.col(roles.outcome)
    g = df.groupBy(key).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    mean = g.agg(F.sum("__s") / F.sum("__n")).scalar()
    enc = F.when(F.col("__n") > 1, (F.col("__s") - y) / (F.col("__n") - 1)).otherwise(mean)
    return df.join(bounded(g), key).withColumn(name or f"{key}_loo_encoded", enc).drop("__s", "__n")


def _shrunk(n: Column, s: Column, gn: Column, gs: Column) -> Column:
    """Empirical-Bayes mean of a 0/1 outcome: weight n*t/(v + n*t) on the category,
    t the global and v the category's population variance."""
    m, gm = s / n, gs / gn
    t, v = gm * (1 - gm), m * (1 - m)
    lam = n * t / (v + n * t)
    return F.when((t <= 0) | (n <= 0), gm).otherwise(lam * m + (1 - lam) * gm)


def _long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in columns])
    return df.select(*keep, F.explode(items).alias("x")).select(*keep, "x.*").filter("category IS NOT NULL")


def fit_target_encoding(train: DataFrame, columns: list[str], roles: Roles = MATCH, smoothing: float | None = None) -> DataFrame:
    """(column_name, category, n, encoded, prior): one scan for all columns.

    The weight of a category is n/(n + smoothing) if that is given, as Spark's own
    TargetEncoder has it, else the empirical-Bayes weight.
    """
    y = F.col(roles.outcome)
    g = _long(train, columns, [roles.outcome]).groupBy("column_name", "category").agg(F.count(y).alias("n"), F.sum(y).alias("s"))
    tot = g.groupBy("column_name").agg(F.sum("n").alias("gn"), F.sum("s").alias("gs"))
    if smoothing is None:
        enc = _shrunk(F.col("n"), F.col("s"), F.col("gn"), F.col("gs"))
    else:
        enc = (F.col("s") + F.col("gs") / F.col("gn") * smoothing) / (F.col("n") + smoothing)
    # one row per encoded column
    return g.join(F.broadcast(tot), "column_name").select(
        "column_name", "category", "n", enc.alias("encoded"),
        (F.col("gs") / F.col("gn")).alias("prior"),
    )


def apply_target_encoding(df: DataFrame, fitted: DataFrame, columns: list[str], prior: Column | None = None) -> DataFrame:
    """Adds <column>_target_encoded; unseen categories get the prior. The encoder has
    one row per category seen: it is landed once, and each column's part is broadcast
    if it is small, so a column of few values is never joined by shuffle."""
    fitted = cut_lineage(fitted)
    prior = fitted.agg(F.max("prior")).scalar() if prior is None else prior

    def add(d, c):
        e = fitted.filter(F.col("column_name") == c).select(F.col("category").alias(f"__k_{c}"), F.col("encoded").alias(f"__e_{c}"))
        return d.join(bounded(e), F.col(c).cast("string") == F.col(f"__k_{c}"), "left").drop(f"__k_{c}")

    out = reduce(add, columns, df)
    out = out.withColumns({f"{c}_target_encoded": F.coalesce(F.col(f"__e_{c}"), prior) for c in columns})
    return out.drop(*[f"__e_{c}" for c in columns])


def fold_of(row: str, folds: int, seed: str = "te") -> Column:
    """Fold from a hash of the row id: the same in every engine and every run."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(row).cast("string"))), 1, 6), 16, 10).cast("long") % folds).cast("int")


def out_of_fold_encoding(df: DataFrame, column: str, folds: int = 5, roles: Roles = MATCH) -> DataFrame:
    """Each row encoded with the sums of the other folds (own fold subtracted)."""
    y = F.col(roles.outcome)
    src = df.withColumn("__f", fold_of(roles.row, folds))
    cf = src.groupBy(column, "__f").agg(F.count(y).alias("n"), F.sum(y).alias("s"))
    cat = cf.groupBy(column).agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    fold = cf.groupBy("__f").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    all_rows = cf.agg(F.struct(F.sum("n").alias("n"), F.sum("s").alias("s"))).scalar()
    rest = (
        cf.join(cat, column).join(F.broadcast(fold), "__f").withColumn("t", all_rows)  # one row per fold
        .select(
            column, "__f", (F.col("cn") - F.col("n")).alias("n"), (F.col("cs") - F.col("s")).alias("s"),
            (F.col("t.n") - F.col("fn")).alias("gn"), (F.col("t.s") - F.col("fs")).alias("gs"),
        )
    )
    enc = rest.select(column, "__f", _shrunk(F.col("n"), F.col("s"), F.col("gn"), F.col("gs")).alias(f"{column}_oof_encoded"))
    return src.join(bounded(enc), [column, "__f"]).withColumnRenamed("__f", "fold")
