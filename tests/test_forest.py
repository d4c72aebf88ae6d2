"""Forests on counted cells: Spark's own trees, draws, folds and partitions."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from boutline.ml import forest, training

NAMES = [f"f{i}" for i in range(4)]


def _scores(d, key="row_id"):
    return np.array([r["p"] for r in sorted(d.collect(), key=lambda r: r[key])])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, k, 2000) / k for k in (4, 11, 32, 7)], axis=1)
    z = x @ np.array([1.0, -2.0, 0.7, 0.3]) + 3 * x[:, 1] * x[:, 2]
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * (z - z.mean())))).astype(int)
    made = [(i, i % 3, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(made, ["row_id", "fold", *NAMES, "result"]).cache()


def _forest(**kw):
    return RandomForestClassifier(featuresCol="features", labelCol="result", **{"numTrees": 8, "maxDepth": 4, "seed": 42, **kw})


def test_one_tree_is_sparks_tree(rows):
    one = _forest(numTrees=1, maxDepth=6, bootstrap=False, featureSubsetStrategy="all")
    own = training.fit_learners(rows, NAMES, {"m": one})["m"]
    assert isinstance(own, forest.Forest)
    spark_own = training.fit_learner(rows, NAMES, one)
    assert np.abs(_scores(training.predict(own, rows, ["row_id"])) - _scores(training.predict(spark_own, rows, ["row_id"]))).max() < 1e-12


def test_boosted_trees_are_sparks(rows):
    gbt = training.learners(len(NAMES))["gradient_boosting"]
    own = training.fit_learners(rows, NAMES, {"m": gbt})["m"]
    assert isinstance(own, forest.OnBins)
    spark_own = training.fit_learner(rows, NAMES, gbt)
    assert np.abs(_scores(training.predict(own, rows, ["row_id"])) - _scores(training.predict(spark_own, rows, ["row_id"]))).max() < 1e-9


def test_rows_alike_are_one_cell(rows):
    bins = forest.find_bins(rows, NAMES)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    once, often = forest.cells(rows, bins), forest.cells(many, bins)
    assert often.count() == once.count() < 2000
    assert often.agg(F.sum("n")).first()[0] == 20 * 2000
    # a count is drawn as the sum of its rows' draws: 40,000 rows vary by 200, not by 20 x 45
    grown = forest.grow(often, bins, _forest(numTrees=40, maxDepth=1, seed=7))
    assert grown.share[:, :, 0].std() < 0.005


def test_runs_agree_for_any_partitions(rows):
    def one(d):
        bins = forest.find_bins(d, NAMES)
        return forest.grow(forest.cells(d, bins), bins, _forest())

    a, b = one(rows.repartition(1)), one(rows.repartition(16))
    assert (a.feature == b.feature).all() and (a.split == b.split).all() and (a.share == b.share).all()


def test_folds_are_grown_together_and_do_not_see_their_rows(rows, monkeypatch):
    calls, own = [], forest.grow
    monkeypatch.setattr(forest, "grow", lambda *a: calls.append(1) or own(*a))
    score = lambda d: training.out_of_fold(d, NAMES, "fold", 3, {"forest": _forest()}, ["row_id", "fold"])
    told, turned = score(rows), score(rows.withColumn("result", F.when(F.col("fold") == 1, 1 - F.col("result")).otherwise(F.col("result"))))
    assert len(calls) == 2  # one growth a call, not one a fold
    assert told.count() == 2000 and told.columns == ["row_id", "fold", "y_true", "p", "model"]
    held = F.col("fold") == 1
    assert (_scores(told.filter(held)) == _scores(turned.filter(held))).all()
    assert (_scores(told.filter(~held)) != _scores(turned.filter(~held))).any()


def test_features_without_values_are_refused(rows):
    bins = forest.find_bins(rows, NAMES)
    with pytest.raises(Exception, match="null or NaN"):
        forest.cells(rows.withColumn("f0", F.when(F.col("row_id") != 5, F.col("f0"))), bins)


def test_a_border_parts_neighbouring_doubles():
    low = 0.4216370213557839
    high = np.nextafter(low, 1)
    for values in ([low, high], [np.nextafter(low, 0), low], [0.1, low, high, 0.9]):
        borders = forest.pick_borders(np.array(values), np.ones(len(values)), 32)
        assert np.searchsorted(borders, values).tolist() == list(range(len(values)))


def test_logistic_models_of_all_folds_are_fitted_together(rows):
    own = training.out_of_fold(rows, NAMES, "fold", 3, {"logistic": None}, ["row_id"])
    assert own.columns == ["row_id", "y_true", "p", "model"] and own.count() == 2000
    for k in range(3):
        held = F.col("fold") == k
        m = training.fit_logistic(rows.filter(~held), NAMES)
        ids = [r.row_id for r in rows.filter(held).select("row_id").collect()]
        assert np.abs(_scores(own.filter(F.col("row_id").isin(ids))) - _scores(training.predict(m, rows.filter(held), ["row_id"]))).max() < 1e-5
