"""Gram matrices are shared at the first step and kept while they serve."""

import numpy as np
from pyspark.sql import functions as F

from boutline.ml import newton
from boutline.ml.newton import Fit


def test_kept_gram_matrices_give_the_same_fits(spark, monkeypatch):
    x = [(F.xxhash64("id", F.lit(i)) % 1000 / 1000.0).alias(f"f{i}") for i in range(4)]
    rows = spark.range(4000).select("id", *x).withColumn("result", (F.col("f0") + F.col("f1") / 2 + F.xxhash64("id", F.lit(9)) % 1000 / 500.0 > 0).cast("int"))
    half = F.col("id") % 2 == 0
    names = [f"f{i}" for i in range(4)]
    d = newton.design(rows, names, {"even": (half, ~half), "odd": (~half, half)})
    fits = [Fit(f"{s}-{c}-{a}", s, c, a) for s in ("even", "odd") for c in (0.01, 1.0) for a in (0.0, 0.5)]
    made, plain = [], newton._derivatives

    def counted(*args):
        made.append(len(set(args[-1].values())))
        return plain(*args)

    monkeypatch.setattr(newton, "_derivatives", counted)
    kept = newton.fit_many(d, names, ["even", "odd"], fits)
    assert made[0] == 2 and sum(made) < len(fits) * kept.steps / 2
    monkeypatch.setattr(newton, "KEEP_GRAM", 0.0)
    anew = newton.fit_many(d, names, ["even", "odd"], fits)
    assert kept.gradient.max() < 1e-8 and anew.gradient.max() < 1e-8
    assert np.abs(kept.coefficients - anew.coefficients).max() < 1e-5


def test_overlapping_subsets_share_a_gram_matrix(spark, monkeypatch):
    """Nested shares by folds: one matrix serves all at the first step, fits of the same
    rows are one, and every fit is the one that it would be alone."""
    x = [(F.xxhash64("id", F.lit(i)) % 1000 / 1000.0).alias(f"f{i}") for i in range(4)]
    rows = spark.range(6000).select("id", *x).withColumn("result", (F.col("f0") - F.col("f1") / 2 + F.xxhash64("id", F.lit(9)) % 1000 / 500.0 > 0).cast("int"))
    names, some = [f"f{i}" for i in range(4)], F.col("id") % 7 == 0
    subsets = {f"{s}-{k}": ((F.col("id") % 5 != k) & (F.col("id") % 100 < s), some) for s in (30, 60, 100) for k in range(5)}
    subsets["again"] = subsets["100-0"]
    d = newton.design(rows, names, subsets)
    made, plain = [], newton._derivatives

    def counted(*args):
        made.append((len(args[2]), len(set(args[-1].values()))))
        return plain(*args)

    monkeypatch.setattr(newton, "_derivatives", counted)
    got = newton.fit_many(d, names, list(subsets), [Fit(k, k) for k in subsets])
    assert made[0] == (15, 1) and sum(m for _, m in made) < 15
    monkeypatch.setattr(newton, "OVERLAP", 2.0)
    alone = newton.fit_many(d, names, list(subsets), [Fit(k, k) for k in subsets])
    assert got.gradient.max() < 1e-8 and np.abs(got.coefficients - alone.coefficients).max() < 1e-6
    assert (got.coefficients[-1] == got.coefficients[10]).all() and got.rows[-1] == got.rows[10]
