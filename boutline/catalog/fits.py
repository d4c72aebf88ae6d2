"""Queries that fit many linear models at once, on the 48 features.

A fit has no SQL counterpart, its optimum has: the weighted gradient with its penalty is
0 for every feature. The ``*_optimality`` queries evaluate it from the rows and the
coefficients, and state in SQL which fits, features and rows there are."""

import random

from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.catalog.base import query
from boutline.catalog.splits import _G, _TAG, _Y, _md5
from boutline.evaluation import metrics as M
from boutline.fixtures import with_views
from boutline.ml import newton, training
from boutline.ml.newton import Fit
from boutline.operators import encoding, splits
from boutline.operators.features import CANONICAL_48, FeatureModel
from boutline.session import cut_lineage

FEATURES = list(CANONICAL_48)
FOLDS = 5


def vectors(spark, sf):
    """Every row's 48 features: lookups of the training part, history before the row. Not
    written: the design, which reads them once, is."""
    return _marked_vectors(spark, sf, lambda rows: (rows, []))


def _marked_vectors(spark, sf, marked):
    """:func:`vectors`; ``marked`` (rows -> rows, names) adds columns to the rows, which are kept."""
    rows = splits.temporal_tags(cut_lineage(fx.wide(spark, sf)), {"split": splits.PRESETS["70_15_15"]})
    model = FeatureModel.fit(rows.filter("split = 'train'").drop("split"))  # without the marks, which no lookup needs
    tagged, names = marked(rows)
    return model.vector(tagged, "rows", ["row_id", "match_date", "result", "split", *names])


def _in(split):
    return F.col("split") == split


def _optimal(rows, fitted, names):
    """|gradient| to four digits, per fit and feature."""
    g = newton.optimality(rows, fitted, names)
    return g.select("fit", "feature", "rows", F.abs(F.round("gradient", 4)).alias("gradient"))


def _names_sql(names):
    return "(SELECT UNNEST([" + ", ".join(f"'{n}'" for n in names) + "]) AS feature)"


_ALL = _names_sql([*FEATURES, "intercept"])
_FOLD = lambda seed, k: f"CAST(CAST('0x' || substr(md5('{seed}-' || CAST(row_id AS VARCHAR)), 1, 6) AS BIGINT) % {k} AS INT)"
_TRAIN = f"SELECT * FROM (SELECT *, {_TAG} AS split FROM ({_G})) WHERE split = 'train'"


def _one(spark, sf):
    d = newton.design(vectors(spark, sf), FEATURES, {"train": (_in("train"), ~_in("train"))}, keep=["row_id", "split"])
    return d, newton.fit_many(d, FEATURES, ["train"], [Fit("ridge", "train"), Fit("elastic", "train", 0.1, 0.5)])


@query("p2_logistic_regression")
def p2(spark, sf):
    d, fitted = _one(spark, sf)
    s = newton.scores(d, fitted, ["train"], ["split"]).filter("fit = 'ridge'")
    return M.report(s, ["split"])


@query("p2_optimality", with_views(f", t AS ({_TRAIN}) SELECT fit, feature, (SELECT COUNT(*) FROM t) AS rows, 0e0 AS gradient FROM {_ALL}, (SELECT UNNEST(['ridge', 'elastic']) AS fit)", "fx_matches"))
def p2o(spark, sf):
    return _optimal(*_one(spark, sf), ["train"])


def _points(samples=50, seed=42):
    """A random sample of the grid over C and the share of L1."""
    grid = [(10.0**e, a) for e in (-4, -3.5, -3, -2.5, -2, -1.5, -1, -0.5, 0, 0.5, 1, 2) for a in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)]
    return random.Random(seed).sample(grid, samples)


def _folded(rows, folds=FOLDS, seed="te"):
    """Rows with their fold, a column of its own: as an expression its hash would be made
    again for every subset that asks for it."""
    return rows.withColumn("_fold", encoding.fold_of("row_id", folds, seed))


def _fold_subsets(folds=FOLDS):
    """Per fold of rows of :func:`_folded`: learn from the others' training rows."""
    fold, train = F.col("_fold"), _in("train")
    return {f"fold{k}": (train & (fold != k), train & (fold == k)) for k in range(folds)}


def _grid(spark, sf):
    subsets = _fold_subsets()
    fits = [Fit(f"{i}-{k}", k, c, a) for i, (c, a) in enumerate(_points()) for k in subsets]
    d = newton.design(_folded(vectors(spark, sf)), FEATURES, subsets)
    return d, newton.fit_many(d, FEATURES, list(subsets), fits), list(subsets)


@query("p4_grid_search")
def p4(spark, sf):
    """50 random points by 5 folds, fitted together: mean and deviation of the held AUC."""
    d, fitted, names = _grid(spark, sf)
    held = newton.held_metrics(d, fitted, names).filter("part = 'held'")
    points = spark.createDataFrame([(str(i), c, a) for i, (c, a) in enumerate(_points())], "point string, c double, l1_share double")
    per = held.groupBy(F.substring_index("fit", "-", 1).alias("point")).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.avg("f1").alias("mean_f1"), F.count("*").alias("folds"))
    return M.rank_models(per.join(F.broadcast(points), "point"), "mean_auc", name="point")


_POINTS_SQL = ", ".join(f"({i}, {c!r}::DOUBLE, {a!r}::DOUBLE)" for i, (c, a) in enumerate(_points()))


@query(
    "p4_optimality",
    with_views(f", t AS ({_TRAIN}), f AS (SELECT {_FOLD('te', FOLDS)} AS fold FROM t), n AS (SELECT k, COUNT(*) FILTER (WHERE fold <> k) AS rows FROM f, (SELECT UNNEST(range(0, {FOLDS})) AS k) GROUP BY k), p(point, c, l1_share) AS (VALUES {_POINTS_SQL}) SELECT CAST(point AS INT) AS point, c, l1_share, CAST(k AS INT) AS fold, rows, true AS optimal FROM p, n", "fx_matches"),
)
def p4o(spark, sf):
    """Each of the 250 fits is at its optimum: no feature's gradient reaches 1e-4."""
    _, fitted, names = _grid(spark, sf)
    rows = [(int(f.name.split("-")[0]), f.c, f.l1_share, names.index(f.subset), int(n), bool(g < 1e-4)) for f, n, g in zip(fitted.fits, fitted.rows, fitted.gradient)]
    return spark.createDataFrame(rows, "point int, c double, l1_share double, fold int, rows long, optimal boolean")


# Models of the stack: name, C, share of L1.
BASE = (("ridge", 1.0, 0.0), ("stiff", 0.001, 0.0), ("lasso", 0.01, 1.0))


def _base_scores(spark, sf):
    """Every training row scored by the models that did not see its fold."""
    subsets = _fold_subsets()
    d = newton.design(_folded(vectors(spark, sf)), FEATURES, subsets, keep=["row_id"])
    fitted = newton.fit_many(d, FEATURES, list(subsets), [Fit(f"{m}-{k}", k, c, a) for m, c, a in BASE for k in subsets])
    s = newton.scores(d, fitted, list(subsets), ["row_id"], ("held",))
    return s.select("row_id", "y_true", "p", F.substring_index("fit", "-", 1).alias("model"))


def _stack(spark, sf):
    names = [m for m, *_ in BASE]
    wide = _base_scores(spark, sf).groupBy("row_id", F.col("y_true").alias("result")).pivot("model", names).agg(F.max("p"))
    d = newton.design(wide, names, {"all": (F.lit(True), F.lit(False))}, keep=["row_id"])
    return d, newton.fit_many(d, names, ["all"], [Fit("stack", "all")])


@query("p6_linear_stack")
def p6s(spark, sf):
    d, fitted = _stack(spark, sf)
    return M.report(newton.scores(d, fitted, ["all"]).withColumnRenamed("fit", "model"), ["model"])


@query("p6_optimality", with_views(f", t AS ({_TRAIN}) SELECT 'stack' AS fit, feature, (SELECT COUNT(*) FROM t) AS rows, 0e0 AS gradient FROM {_names_sql([*(m for m, *_ in BASE), 'intercept'])}", "fx_matches"))
def p6o(spark, sf):
    return _optimal(*_stack(spark, sf), ["all"])


SIZES = [i / 10 for i in range(1, 11)]


def _sized(spark, sf):
    frac = F.conv(F.substring(F.md5(F.concat(F.lit("lc-"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    subsets = {f"{s}-{k}": (learn & (F.col("_frac") < s), held) for s in SIZES for k, (learn, held) in _fold_subsets().items()}
    d = newton.design(_folded(vectors(spark, sf)).withColumn("_frac", frac), FEATURES, subsets)
    return d, newton.fit_many(d, FEATURES, list(subsets), [Fit(k, k) for k in subsets]), list(subsets)


def _curve(d, fitted, names, point):
    """Mean and deviation over folds of the AUC on learnt and on held rows. A fit is named
    by its point and, after the last dash, its fold; the point may hold a dash (1e-06)."""
    m = newton.held_metrics(d, fitted, names)
    return m.groupBy(F.regexp_replace("fit", "-[^-]*$", "").cast("double").alias(point), "part").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.avg("log_loss").alias("log_loss"), F.count("*").alias("folds"))


@query("p12_learning_curve")
def p12(spark, sf):
    """Ten nested training shares by five folds."""
    return _curve(*_sized(spark, sf), "size")


@query(
    "p12_optimality",
    with_views(
        f", t AS ({_TRAIN}), f AS (SELECT {_FOLD('te', FOLDS)} AS fold, CAST('0x' || substr(md5('lc-' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM t)"
        f" SELECT size, CAST(k AS INT) AS fold, COUNT(*) FILTER (WHERE fold <> k AND u < size) AS rows, true AS optimal FROM f, (SELECT UNNEST({SIZES}) ::DOUBLE AS size), (SELECT UNNEST(range(0, {FOLDS})) AS k) GROUP BY size, k",
        "fx_matches",
    ),
)
def p12o(spark, sf):
    _, fitted, _ = _sized(spark, sf)
    rows = [(float(f.name.split("-")[0]), int(f.name[-1]), int(n), bool(g < 1e-4)) for f, n, g in zip(fitted.fits, fitted.rows, fitted.gradient)]
    return spark.createDataFrame(rows, "size double, fold int, rows long, optimal boolean")


@query("p12_validation_curve")
def p12v(spark, sf):
    """Ten values of C by five folds."""
    subsets = _fold_subsets()
    fits = [Fit(f"{10.0**e!r}-{k}", k, 10.0**e) for e in range(-6, 4) for k in subsets]
    d = newton.design(_folded(vectors(spark, sf)), FEATURES, subsets)
    return _curve(d, newton.fit_many(d, FEATURES, list(subsets), fits), list(subsets), "c")


@query("p12_diagnosis")
def p12d(spark, sf):
    """The learning curve's verdict."""
    return training.diagnose(_curve(*_sized(spark, sf), "size"), "size")


def _when(d):
    """What splits are made from."""
    return d.select("row_id", "match_date", "result", "year")


def _strategies(d):
    """Rows with one split column for each strategy and ratio, before the features are
    looked up."""
    cuts = lambda name: {f"{name}-{key}": r for key, r in splits.PRESETS.items()}
    d = splits.temporal_tags(d, cuts("pure"))
    d = splits.temporal_tags(d, cuts("stratified"), ["year"], 10)
    return splits.random_tags(d, cuts("random")), [f"{n}-{k}" for n in ("pure", "stratified", "random") for k in splits.PRESETS]


def _compared(spark, sf):
    names = [f"{n}-{k}" for n in ("pure", "stratified", "random") for k in splits.PRESETS]
    subsets = {f"{n}-{part}": (F.col(f"`{n}`") == "train", F.col(f"`{n}`") == part) for n in names for part in ("val", "test")}
    rows = newton.design(_marked_vectors(spark, sf, _strategies), FEATURES, subsets)
    return rows, newton.fit_many(rows, FEATURES, list(subsets), [Fit(k, k) for k in subsets]), list(subsets)


@query("p16_compare_splits")
def p16(spark, sf):
    """Three strategies by three ratios: training, validation and test metrics, and gaps."""
    m = newton.held_metrics(*_compared(spark, sf))
    piece = lambda i: F.element_at(F.split("fit", "-"), i)
    long = m.select(piece(1).alias("strategy"), piece(2).alias("ratio"), F.when(F.col("part") == "train", "train").otherwise(piece(3)).alias("split"), "rows", "auc", "accuracy", "f1", "log_loss").distinct()
    gaps = M.generalization_gap(long, ["strategy", "ratio"])
    return long.join(gaps.select("strategy", "ratio", "gap_score", "label"), ["strategy", "ratio"])


_PRE = [(k, r) for k, r in splits.PRESETS.items()]
_RATIOS = ", ".join(f"('{k}', {r[0]!r}::DOUBLE)" for k, r in _PRE)


@query(
    "p16_optimality",
    with_views(
        f", r(ratio, a) AS (VALUES {_RATIOS}), k AS (SELECT 'pure' AS strategy, row_id, k, n FROM ({_G}) UNION ALL SELECT 'stratified', row_id, k, n FROM ({_Y}) WHERE n >= 10"
        f" UNION ALL SELECT 'random', row_id, k, n FROM (SELECT *, {_md5('year')} FROM fx_matches) WHERE n >= 10) SELECT strategy, ratio, COUNT(*) FILTER (WHERE k < FLOOR(n * a)) AS rows, true AS optimal FROM k, r GROUP BY strategy, ratio",
        "fx_matches",
    ),
)
def p16o(spark, sf):
    _, fitted, _ = _compared(spark, sf)
    rows = {(*f.name.split("-")[:2], int(n), bool(g < 1e-4)) for f, n, g in zip(fitted.fits, fitted.rows, fitted.gradient)}
    return spark.createDataFrame(sorted(rows), "strategy string, ratio string, rows long, optimal boolean")


@query("p16_fold_scores")
def p16f(spark, sf):
    """Year-stratified folds and expanding windows side by side."""
    roles = [(name, n, r) for name, n in (("strat", 5), ("inner", len(splits.INNER_WINDOWS))) for r in ("train", "val")]
    subsets = {f"{name}-{k}": tuple(F.col(f"{name}_{r}").bitwiseAND(F.lit(1 << k)) != 0 for r in ("train", "val")) for name, n, r in roles if r == "train" for k in range(n)}

    def marked(d):
        rows = d
        for name, folds in (("strat", splits.stratified_folds(_when(d))), ("inner", splits.expanding_folds(_when(d), splits.INNER_WINDOWS))):
            bit = lambda role: F.coalesce(F.bit_or(F.when(F.col("role") == role, F.expr("1 << fold"))), F.lit(0))
            rows = rows.join(folds.groupBy("row_id").agg(bit("train").alias(f"{name}_train"), bit("val").alias(f"{name}_val")), "row_id", "left")
        rows = cut_lineage(rows)
        return rows, [f"{name}_{r}" for name, _, r in roles]

    rows = newton.design(_marked_vectors(spark, sf, marked), FEATURES, subsets)
    m = newton.held_metrics(rows, newton.fit_many(rows, FEATURES, list(subsets), [Fit(k, k) for k in subsets]), list(subsets))
    return m.filter("part = 'held'").select(F.substring_index("fit", "-", 1).alias("scheme"), F.substring_index("fit", "-", -1).cast("int").alias("fold"), "rows", "auc", "accuracy", "f1")


@query("p16_nested_cv")
def p16n(spark, sf):
    """Five outer folds; within each, C is chosen by four inner folds."""
    outer, inner, cs = FOLDS, 4, (0.001, 0.01, 0.1, 1.0, 10.0)
    o, i = F.col("_outer"), F.col("_inner")
    rows = vectors(spark, sf).withColumns({"_outer": encoding.fold_of("row_id", outer, "outer"), "_inner": encoding.fold_of("row_id", inner, "inner")})
    subsets = {f"{a}-{b}": ((o != a) & (i != b), (o != a) & (i == b)) for a in range(outer) for b in range(inner)} | {f"{a}-all": (o != a, o == a) for a in range(outer)}
    d = newton.design(rows, FEATURES, subsets)
    fitted = newton.fit_many(d, FEATURES, list(subsets), [Fit(f"{k}-{c}", k, c) for k in subsets for c in cs])
    m = newton.held_metrics(d, fitted, list(subsets)).filter("part = 'held'")
    piece = lambda k: F.element_at(F.split("fit", "-"), k)
    m = m.select(piece(1).cast("int").alias("fold"), piece(2).alias("inner"), piece(3).cast("double").alias("c"), "rows", "auc", "f1")
    chosen = m.filter("inner <> 'all'").groupBy("fold", "c").agg(F.avg("auc").alias("inner_auc")).groupBy("fold").agg(F.max_by("c", F.struct("inner_auc", "c")).alias("c"), F.max("inner_auc").alias("inner_auc"))
    return m.filter("inner = 'all'").join(chosen, ["fold", "c"]).select("fold", "c", "inner_auc", "rows", "auc", "f1")
