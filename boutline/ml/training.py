"""Training and evaluation of win-probability models as Spark ML jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.ml import forest, newton
from boutline.session import cut_lineage


def balanced_weights(df: DataFrame, label: str = "result", name: str = "class_weight") -> DataFrame:
    """n / (2 * n_class), from one count of both classes."""
    c = df.agg(F.struct(F.count("*").alias("n"), F.sum(label).alias("p"))).scalar()
    out = df.withColumn("__c", c)
    n, p = F.col("__c.n"), F.col("__c.p")
    return out.withColumn(name, n / (2.0 * F.when(F.col(label) == 1, p).otherwise(n - p))).drop("__c")


def scaled_vector(features: list[str], out: str = "features") -> list:
    """Assembler and scaler. Spark divides by the sample deviation; over n rows the
    difference to the population form is the factor sqrt((n-1)/n)."""
    return [
        VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="error"),
        StandardScaler(inputCol="__raw", outputCol=out, withMean=True, withStd=True),
    ]


def logistic(rows: int, c: float = 1.0, l1_share: float = 0.0, label: str = "result", weight: str | None = "class_weight", max_iter: int = 100) -> LogisticRegression:
    """Penalised as 1/(C*n): class weights of ``balanced_weights`` sum to n."""
    lr = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=1.0 / (c * rows), elasticNetParam=l1_share, maxIter=max_iter, standardization=False, tol=1e-8
    )
    return lr.setWeightCol(weight) if weight else lr


def learners(n_features: int, label: str = "result", seed: int = 42) -> dict:
    """Counterparts of the tree, network and linear-margin learners."""
    return {
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=50, maxDepth=8, seed=seed),
        "gradient_boosting": GBTClassifier(featuresCol="features", labelCol=label, maxIter=20, maxDepth=4, seed=seed),
        "neural_network": MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[n_features, 32, 2], maxIter=60, seed=seed),
        "linear_svm": LinearSVC(featuresCol="features", labelCol=label, maxIter=50, regParam=0.01),
    }


def fit_logistic(train: DataFrame, features: list[str], c: float = 1.0, l1_share: float = 0.0, label: str = "result"):
    """Scaler and balanced logistic regression, fitted on training rows."""
    n = train.count()
    d = balanced_weights(train, label)
    return Pipeline(stages=[*scaled_vector(features), logistic(n, c, l1_share, label)]).fit(d)


def fit_learner(train: DataFrame, features: list[str], learner):
    return Pipeline(stages=[*scaled_vector(features), learner]).fit(train)


def fit_learners(train: DataFrame, features: list[str], models: dict, label: str = "result") -> dict:
    """Every model fitted on the same rows. Tree learners see binned rows, which are counted
    once a number of bins (scaling does not move a row's bin)."""
    counted, out = {}, {}
    for name, learner in models.items():
        if not (forest.covers(learner) or forest.covers_boosting(learner)):
            out[name] = fit_learner(train, features, learner)
            continue
        most = learner.getMaxBins()
        if most not in counted:
            bins = forest.find_bins(train, features, most)
            counted[most] = forest.cells(train, bins, label), bins
        out[name] = forest.grow(*counted[most], learner) if forest.covers(learner) else forest.boost(*counted[most], learner, label)
    return out


def predict(model, df: DataFrame, keep: list[str], label: str = "result") -> DataFrame:
    """(keep..., y_true, p). Margins without a probability go through a sigmoid."""
    if isinstance(model, (forest.Forest, forest.OnBins)):
        return model.predict(df, keep, label)
    d = model.transform(df.withColumn("class_weight", F.lit(1.0)) if "class_weight" not in df.columns else df)
    if "probability" in d.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return d.select(*keep, F.col(label).alias("y_true"), p.alias("p"))


def out_of_fold(df: DataFrame, features: list[str], fold: str, folds: int, models: dict, keep: list[str], label: str = "result") -> DataFrame:
    """Long (keep..., y_true, p, model): every row scored by models that did not see
    its fold. One fit per (fold, model); the forests of all folds are grown together, and
    so are the logistic models (``None``) fitted, with the objective of ``fit_logistic``."""
    parts = []
    for name, make in models.items():
        if make is None:
            subsets = {str(k): (F.col(fold) != k, F.col(fold) == k) for k in range(folds)}
            rows = newton.design(df, features, subsets, label, keep)
            fitted = newton.fit_many(rows, features, list(subsets), [newton.Fit(k, k) for k in subsets])
            s = newton.scores(rows, fitted, list(subsets), keep, ("held",))
            parts.append(s.select(*keep, F.col("y_true").cast(dict(df.dtypes)[label]).alias("y_true"), "p", F.lit(name).alias("model")))
            continue
        if forest.covers(make):
            known = df.filter(F.col(fold).between(0, folds - 1))
            dealt = df.filter(F.col(fold).isNotNull())
            bins = forest.find_bins(dealt, features, make.getMaxBins(), fold, folds)
            grown = forest.grow(forest.cells(dealt, bins, label, fold), bins, make)
            parts.append(grown.predict(known, keep, label, fold).withColumn("model", F.lit(name)))
            continue
        for k in range(folds):
            train, held = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
            m = fit_learner(train, features, make)
            parts.append(predict(m, held, keep, label).withColumn("model", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def stack(oof: DataFrame, names: list[str], row: str, label: str = "y_true"):
    """Meta-learner on out-of-fold probabilities, one column per model. The rows are turned
    once: the fit and what scores them read the written table."""
    wide = cut_lineage(oof.groupBy(row, label).pivot("model", names).agg(F.max("p")))
    n = wide.count()
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), logistic(n, label=label, weight=None)])
    return pipe.fit(wide), wide


def vote_weights(scores: DataFrame, kind: str = "f1") -> DataFrame:
    """Weights of a soft vote from (model, f1, auc, cv_mean, cv_std)."""
    w = {
        "f1": F.col("f1") / (1 + F.col("cv_std")),
        "balanced": F.col("auc") * 0.5 + F.col("cv_mean") * 0.3 + (1 - F.col("cv_std")) * 0.2,
        "performance": F.col("auc") * 0.4 + F.col("f1") * 0.4 + F.col("cv_mean") * 0.2,
    }[kind]
    return scores.withColumn("weight", w)


def diverse_models(correlations: DataFrame, aucs: DataFrame, most: int = 4) -> list[str]:
    """Greedy pick of models that agree least, starting from the best. Works on the
    result table of model pairs (a few rows)."""
    auc = {r["model"]: r["auc"] for r in aucs.collect()}
    corr = {}
    for r in correlations.collect():
        corr[(r["first"], r["second"])] = corr[(r["second"], r["first"])] = abs(r["corr"])
    left = sorted(auc, key=lambda m: (-auc[m], m))
    chosen = [left.pop(0)]
    while left and len(chosen) < most:
        nxt = min(left, key=lambda m: (sum(corr.get((m, s), 0.0) for s in chosen) / len(chosen), m))
        left.remove(nxt)
        chosen.append(nxt)
    return chosen


def _logit(p):
    q = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), F.col(p)))
    return F.ln(q / (1 - q))


def calibration_slope(df: DataFrame, y: str = "y_true", p: str = "p") -> tuple[float, float]:
    """Slope and intercept of the outcome on log-odds. Rows are first reduced to
    (score, outcome) cells, which the fit weighs by their counts."""
    cells = df.groupBy(p, y).agg(F.count("*").cast("double").alias("n"))
    n = cells.agg(F.sum("n")).first()[0]
    d = VectorAssembler(inputCols=["lo"], outputCol="features").transform(cells.withColumn("lo", _logit(p)))
    m = logistic(int(n), label=y, weight="n", max_iter=1000).fit(d)
    return float(m.coefficients[0]), float(m.intercept)


def platt(df: DataFrame, y: str = "y_true", p: str = "p"):
    """Calibrator by logistic regression on log-odds; returns DataFrame -> DataFrame."""
    slope, intercept = calibration_slope(df, y, p)
    return lambda d: d.withColumn("p_calibrated", 1 / (1 + F.exp(-(_logit(p) * slope + intercept))))


def isotonic(df: DataFrame, y: str = "y_true", p: str = "p"):
    """Monotone calibrator, fitted on weighted (score) cells."""
    cells = df.groupBy(p).agg((F.sum(y) / F.count("*")).alias("rate"), F.count("*").cast("double").alias("n"))
    m = IsotonicRegression(featuresCol=p, labelCol="rate", weightCol="n").fit(cells)
    return lambda d: m.transform(d).withColumn("p_calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def coefficients(model, features: list[str]) -> DataFrame:
    """(feature, coefficient) of the last stage of a fitted pipeline."""
    lr = model.stages[-1]
    from pyspark.sql import SparkSession

    rows = [(f, float(c)) for f, c in zip(features, lr.coefficients)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coefficient double")


def linear_contributions(df: DataFrame, fitted: DataFrame, coef: dict[str, float], row: str, top: int = 8, scale: float = 0.25, least: float = 0.0) -> DataFrame:
    """(row, feature, contribution, impact_pct, place): coefficient times scaled
    value, the top by size. A row's features form one array in the row itself, so
    there is no shuffle; ``scale`` turns log-odds into probability near one half.
    """
    from boutline.operators.features import scale_apply

    names = list(coef)
    z = scale_apply(df.select(row, *[F.col(c).cast("double").alias(c) for c in names]), fitted, names)
    items = F.array(*[F.struct((-F.abs(F.col(c) * v)).alias("o"), F.lit(c).alias("feature"), (F.col(c) * v).alias("contribution")) for c, v in coef.items()])
    best = F.slice(F.array_sort(F.filter(items, lambda x: -x["o"] * scale >= least)), 1, top)
    return z.select(row, F.posexplode(best).alias("i", "x")).select(
        row, "x.feature", "x.contribution", F.round(F.col("x.contribution") * scale * 100, 1).alias("impact_pct"), (F.col("i") + 1).alias("place")
    )


def global_importance(df: DataFrame, fitted: DataFrame, coef: dict[str, float]) -> DataFrame:
    """Mean absolute contribution per feature: one aggregate of all features."""
    from boutline.operators.features import scale_apply

    names = list(coef)
    z = scale_apply(df.select(*[F.col(c).cast("double").alias(c) for c in names]), fitted, names)
    g = z.agg(*[F.avg(F.abs(F.col(c) * v)).alias(c) for c, v in coef.items()])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names])).alias("x")).select("x.*")


def diagnose(curve: DataFrame, size: str = "size") -> DataFrame:
    """Verdict on a learning curve (size, part train/held, mean_auc): one row with the
    scores at the largest size, the held score of the middle one, and the verdict."""
    at = F.array_sort(F.collect_list(F.when(F.col("part") == "held", F.struct(F.col(size).alias("s"), F.col("mean_auc").alias("v")))))  # one entry a size
    last = F.max_by(F.when(F.col("part") == "train", F.col("mean_auc")), F.when(F.col("part") == "train", F.col(size)))
    d = curve.agg(last.alias("train_auc"), at.alias("h")).select("train_auc", F.element_at("h", -1)["v"].alias("held_auc"), F.element_at("h", F.floor(F.size("h") / 2).cast("int") + 1)["v"].alias("middle_auc"))
    t, v = F.col("train_auc"), F.col("held_auc")
    settled = F.abs(v - F.col("middle_auc")) < 0.01
    verdict = (
        F.when((t - v > 0.1) & (v < 0.6), "high_variance").when(t - v > 0.1, "moderate_overfitting").when((t < 0.7) & (v < 0.7), "high_bias")
        .when(settled & (v > 0.75), "well_fitted").when(settled, "acceptable").otherwise("not_converged")
    )
    return d.withColumn("verdict", verdict)
