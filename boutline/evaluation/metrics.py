"""Evaluation of predictions: (keys..., id, y_true 0/1, p).

Every operator groups by ``keys`` (model, split, year, ...) and is one or a few
aggregates with map-side combine. Where an order is needed (AUC, net benefit) rows
are first reduced to distinct scores or threshold cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.scalar import clip, interval_bin, ratio
from boutline.plans.ordered import quantiles, running, value_levels, value_slots
from boutline.session import cut_lineage

EPS = 1e-15


def _one_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])


def log_loss_of(y: Column, p: Column) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5, y: str = "y_true", p: str = "p") -> DataFrame:
    """tp, fp, tn, fn per key from one aggregate."""
    pos, hit = F.col(y) == 1, F.col(p) >= threshold
    return df.groupBy(*keys).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn")
    )


def rates_of_confusion(c: DataFrame) -> DataFrame:
    """Accuracy to kappa from the four counts; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec, rec, spec = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0), ratio(tn, tn + fp, 0.0)
    acc = ratio(tp + tn, n, 0.0)
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return c.withColumns(
        {
            "accuracy": acc, "precision": prec, "recall": rec, "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0), "specificity": spec,
            "sensitivity": rec, "balanced_accuracy": (rec + spec) / 2, "mcc": ratio(tp * tn - fp * fn, den, 0.0),
            "kappa": F.when(chance < 1, (acc - chance) / (1 - chance)).otherwise(F.lit(0.0)),
        }
    )


def confusion_metrics(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    return rates_of_confusion(confusion(df, keys, threshold))


def auc(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "p", weight: str | None = None) -> DataFrame:
    """Mann-Whitney AUC with ties, exact: rows -> distinct scores -> negatives below
    each score by slot prefix sums."""
    d, ks = _one_key(df, keys)
    w = F.col(weight) if weight else F.lit(1)
    cells = d.groupBy(*ks, p).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"))
    r = running(cells, ks, value_levels(p), [p], {"below": ("sum", F.col("neg"))})
    out = r.groupBy(*ks).agg(
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc")
    )
    return out if keys else out.drop("__all")


def log_loss_brier(df: DataFrame, keys: list[str]) -> DataFrame:
    y, p = F.col("y_true"), F.col("p")
    return df.groupBy(*keys).agg(F.avg(log_loss_of(y, p)).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"))


def reliability(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per bin (lo, hi]: rows, mean p, share of positives."""
    b = df.withColumn("bin", interval_bin(F.col("p"), bins)).filter("bin > 0")
    return b.groupBy(*keys, "bin").agg(F.count("*").alias("rows"), F.avg("p").alias("mean_p"), (F.sum("y_true") / F.count("*")).alias("positive_rate"))


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """ECE and MCE; rows with p = 0 are in no bin but count in N."""
    d, ks = _one_key(df, keys)
    g = d.withColumn("bin", interval_bin(F.col("p"), bins)).groupBy(*ks, "bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("mp"), (F.sum("y_true") / F.count("*")).alias("my")
    )
    gap = F.when(F.col("bin") > 0, F.abs(F.col("my") - F.col("mp"))).otherwise(F.lit(0.0))
    out = g.groupBy(*ks).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return out if keys else out.drop("__all")


def net_benefit(df: DataFrame, keys: list[str], steps: int = 99) -> DataFrame:
    """Decision curve at thresholds i/100: model, treat all, treat none.

    A row falls in the cell of its largest threshold <= p; a threshold's counts are
    the cells from it upwards. The rows are never multiplied by thresholds.
    """
    d, ks = _one_key(df, keys)
    k = F.floor(F.col("p") * 100)
    cell = k + (F.col("p") >= (k + 1) / 100.0).cast("int") - (F.col("p") < k / 100.0).cast("int")
    cells = d.withColumn("cell", F.least(F.greatest(cell, F.lit(0)), F.lit(steps))).groupBy(*ks, "cell").agg(
        F.sum("y_true").alias("pos"), F.count("*").alias("n")
    )
    spread = cells.select(*ks, "pos", "n", F.explode(F.filter(F.sequence(F.lit(0), F.col("cell").cast("int")), lambda i: (i >= 0))).alias("i"))
    up = spread.groupBy(*ks, "i").agg(F.sum("pos").alias("tp"), F.sum("n").alias("hit"))
    tot = cells.groupBy(*ks).agg(F.sum("pos").alias("P"), F.sum("n").alias("N"))
    grid = tot.select(*ks, "P", "N", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"))
    j = grid.join(up, [*ks, "i"], "left")
    t = F.col("i") / 100.0
    tp, hit = F.coalesce("tp", F.lit(0)), F.coalesce("hit", F.lit(0))
    odds, prev = t / (1 - t), F.col("P") / F.col("N")
    return j.select(
        *keys, F.col("i").alias("threshold_pct"), (tp / F.col("N") - (hit - tp) / F.col("N") * odds).alias("net_benefit"),
        (prev - (1 - prev) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"),
    )


# Weights of the composite scores.
COMPOSITE_5 = {"auc": 0.30, "log_loss": 0.25, "brier": 0.20, "ece": 0.15, "f1": 0.10}
COMPOSITE_7 = {"auc": 0.25, "log_loss": 0.20, "brier": 0.15, "ece": 0.10, "f1": 0.10, "mcc": 0.10, "kappa": 0.10}


def composite(weights: dict[str, float] = COMPOSITE_5) -> Column:
    scaled = {
        "auc": F.col("auc"), "f1": F.col("f1"), "log_loss": 1 / (1 + F.col("log_loss")), "brier": 1 - F.col("brier"),
        "ece": 1 - F.col("ece"), "mcc": (F.col("mcc") + 1) / 2, "kappa": (F.col("kappa") + 1) / 2,
    }
    return reduce(lambda a, b: a + b, [scaled[k] * F.lit(w) for k, w in weights.items()])


def report(df: DataFrame, keys: list[str]) -> DataFrame:
    """All of the above, one row per key. Rows are reduced once to (key, score)
    cells, and everything is computed from the written cells: one shuffle of the rows."""
    d, ks = _one_key(df, keys)
    cells = cut_lineage(d.groupBy(*ks, "p").agg(F.sum("y_true").alias("pos"), F.count("*").alias("n")))
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    neg = n - pos
    ll = -(pos * F.ln(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))) + neg * F.ln(1 - F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))))
    br = pos * (1 - p) * (1 - p) + neg * p * p
    r = running(cells, ks, value_slots(cells, ks, "p"), ["p"], {"below": ("sum", n - pos)}).withColumn("bin", interval_bin(p))
    by_bin = r.groupBy(*ks, "bin").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(p * n).alias("sp"), F.sum(ll).alias("ll"), F.sum(br).alias("br"),
        F.sum(pos * (F.col("below") + neg / 2)).alias("u"),
        F.sum(F.when(p >= 0.5, pos).otherwise(0)).alias("tp"), F.sum(F.when(p >= 0.5, neg).otherwise(0)).alias("fp"),
    )
    gap = F.when(F.col("bin") > 0, F.abs(F.col("pos") - F.col("sp"))).otherwise(F.lit(0.0))
    g = by_bin.groupBy(*ks).agg(
        F.sum("n").alias("rows"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("pos").alias("__P"),
        (F.sum("ll") / F.sum("n")).alias("log_loss"), (F.sum("br") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"),
        F.max(gap / F.col("n")).alias("mce"), (F.sum("u") / (F.sum("pos") * (F.sum("n") - F.sum("pos")))).alias("auc"),
    )
    g = g.withColumns({"fn": F.col("__P") - F.col("tp"), "tn": F.col("rows") - F.col("__P") - F.col("fp")})
    out = rates_of_confusion(g).withColumns({"composite": composite(COMPOSITE_5), "composite7": composite(COMPOSITE_7)})
    return out.drop("__P", *([] if keys else ["__all"]))


def rank_models(metrics: DataFrame, by: str = "composite", within: list[str] | None = None, name: str = "model") -> DataFrame:
    """Rank 1.. of one row per model (a result table)."""
    w = Window.partitionBy(*(within or [])).orderBy(F.desc(by), name)
    return metrics.withColumn("rank", F.row_number().over(w))


def mcnemar(df: DataFrame, a: str, b: str, keys: list[str] | None = None, y: str = "y_true") -> DataFrame:
    """Discordant counts of two probability columns and the corrected statistic;
    ``p_value`` of functions.scalar.chi2_1_sf applies to the result row."""
    ok_a, ok_b = ((F.col(a) >= 0.5).cast("int") == F.col(y)), ((F.col(b) >= 0.5).cast("int") == F.col(y))
    g = df.groupBy(*(keys or [])).agg(F.count_if(ok_a & ~ok_b).alias("b"), F.count_if(~ok_a & ok_b).alias("c"))
    d = F.abs(F.col("b") - F.col("c")) - 1
    return g.withColumn("statistic", F.when(F.col("b") + F.col("c") > 0, d * d / (F.col("b") + F.col("c"))).otherwise(F.lit(0.0)))


def poisson_cuts() -> list[str]:
    """Cumulative Poisson(1) probabilities in units of 2^-16 as four hex digits: a
    16-bit piece of a hash maps to a resampling weight by text comparison."""
    import math

    c, out = 0.0, []
    for k in range(9):
        c += math.exp(-1) / math.factorial(k)
        out.append(f"{round(c * 65536):04x}")
    return [x for x in out if len(x) == 4]


def resampling_weight(digest: Column | str, i: int) -> Column:
    """Poisson(1) weight from the i-th of eight pieces of an md5 text."""
    u = F.substring(digest, 4 * i + 1, 4)
    w = F.when(u < poisson_cuts()[0], 0)
    for k, c in enumerate(poisson_cuts()[1:], 1):
        w = w.when(u < c, k)
    return w.otherwise(len(poisson_cuts()))


def bootstrap_metrics(df: DataFrame, keys: list[str], row: str, replicates: int = 200) -> DataFrame:
    """Accuracy, Brier score and AUC of every replicate of a Poisson bootstrap.

    One md5 of the row id serves eight replicates, whose weights are summed side by
    side into (key, score) cells map-side; only cells are unfolded and ordered. The
    draw depends on the row id only: the same after a lost task is run again.
    """
    groups = (replicates + 7) // 8
    h = df.select(*keys, row, "y_true", "p", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__g")).withColumn(
        "__h", F.md5(F.concat(F.col(row).cast("string"), F.lit("-"), F.col("__g").cast("string")))
    )
    hit = F.col("y_true") == 1
    sums = []
    for i in range(8):
        w = resampling_weight("__h", i)
        sums += [F.sum(F.when(hit, w).otherwise(0)).alias(f"p{i}"), F.sum(F.when(hit, 0).otherwise(w)).alias(f"n{i}")]
    g = h.groupBy(*keys, "__g", "p").agg(*sums)
    items = F.array(*[F.struct((F.col("__g") * 8 + i).alias("replicate"), F.col(f"p{i}").alias("pos"), F.col(f"n{i}").alias("neg")) for i in range(8)])
    keep = F.filter(items, lambda x: (x["replicate"] < replicates) & (x["pos"] + x["neg"] > 0))
    cells = g.select(*keys, "p", F.explode(keep).alias("x")).select(*keys, "p", "x.*")
    ks = [*keys, "replicate"]
    r = running(cells, ks, value_levels("p"), ["p"], {"below": ("sum", F.col("neg"))})
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    return r.groupBy(*ks).agg(
        (F.sum(F.when(p >= 0.5, pos).otherwise(neg)) / n).alias("accuracy"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / n).alias("brier"),
        (F.sum(pos * (F.col("below") + neg / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
    )


def bootstrap_interval(reps: DataFrame, keys: list[str], metric: str, level: float = 0.95) -> DataFrame:
    """Mean, deviation and percentile interval over the replicates."""
    a = (1 - level) / 2
    q = quantiles(reps, keys, metric, {"ci_lower": a, "ci_upper": 1 - a})
    s = reps.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(metric).alias("replicates"))
    return s.join(q, keys) if keys else s.withColumn("__k", F.lit(1)).join(q.withColumn("__k", F.lit(1)), "__k").drop("__k")


def t_against(reps: DataFrame, keys: list[str], metric: str, baseline: float) -> DataFrame:
    """One-sample t of the replicates against a baseline; improvement in percent."""
    m, s, n = F.avg(metric), F.stddev_samp(metric), F.count(metric)
    return reps.groupBy(*keys).agg(
        (m - baseline).alias("mean_difference"), ((m - baseline) / (s / F.sqrt(n))).alias("t"), ((m - baseline) / F.lit(baseline) * 100).alias("improvement_pct"), n.alias("n")
    )


def confidence(df: DataFrame, residual: Column | None = None, high: float = 0.70, medium: float = 0.55, p: str = "p") -> DataFrame:
    """Level and bounds of each probability. ``residual`` is the 95th percentile of
    |p - y| on a calibration set, or None for the fixed margin of 0.15."""
    away = F.abs(F.col(p) - 0.5)
    eff = away + 0.5
    margin = (F.lit(0.15) if residual is None else residual) * (1 - away)
    return df.withColumns(
        {
            "confidence_level": F.when(eff >= high, "high").when(eff >= medium, "medium").otherwise("low"),
            "lower_bound": clip(F.col(p) - margin, 0.0, 1.0),
            "upper_bound": clip(F.col(p) + margin, 0.0, 1.0),
        }
    )


def penalised_confidence(df: DataFrame, penalty: str, p: str = "p") -> DataFrame:
    """Confidence of the likelier side, reduced by the penalty of edge cases, its
    level, and bounds that are wider near one half."""
    c = F.greatest(F.col(p), 1 - F.col(p)) * (1 - F.col(penalty))
    margin = F.lit(0.10) * (1 - F.abs(F.col(p) - 0.5) * 2) + 0.05
    return df.withColumns(
        {
            "confidence": c, "confidence_level": F.when(c >= 0.70, "high").when(c >= 0.55, "medium").otherwise("low"),
            "lower_bound": F.greatest(F.col(p) - margin, F.lit(0.0)), "upper_bound": F.least(F.col(p) + margin, F.lit(1.0)),
        }
    )


def with_p_value(result: DataFrame, statistic: str, keys: list[str], sf=None) -> DataFrame:
    """Adds p_value to a result table of a few rows (one per key), on the driver.
    ``sf`` maps the statistic to its tail; chi-squared with one degree by default."""
    from boutline.functions.scalar import chi2_1_sf

    sf = sf or chi2_1_sf
    rows = [(*[r[k] for k in keys], float(r[statistic]), float(sf(r[statistic]))) for r in result.select(*keys, statistic).collect()]
    t = dict(result.dtypes)
    sch = ", ".join([*[f"{k} {t[k]}" for k in keys], f"{statistic} double", "p_value double"])
    return result.sparkSession.createDataFrame(rows, sch)


def residual_quantile(calibration: DataFrame, level: float = 0.95) -> Column:
    r = calibration.select(F.abs(F.col("p") - F.col("y_true")).alias("r"))
    return quantiles(r, [], "r", {"q": level}).select("q").scalar()


def generalization_gap(metrics: DataFrame, keys: list[str], split: str = "split", train: str = "train", val: str = "val") -> DataFrame:
    """Train minus validation, weighted .4 AUC, .3 F1, .3 accuracy, and its label."""
    m = {c: (F.max(F.when(F.col(split) == train, F.col(c))) - F.max(F.when(F.col(split) == val, F.col(c)))) for c in ("auc", "f1", "accuracy")}
    g = metrics.groupBy(*keys).agg(*[v.alias(f"{c}_gap") for c, v in m.items()])
    s = F.col("auc_gap") * 0.4 + F.col("f1_gap") * 0.3 + F.col("accuracy_gap") * 0.3
    label = F.when(s > 0.05, "high_overfitting").when(s > 0.02, "moderate_overfitting").when(s > -0.02, "good").otherwise("underfitting")
    return g.withColumns({"gap_score": s, "label": label})


LOWER_IS_BETTER = ("log_loss", "brier", "ece", "generalization_gap")


def to_long(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*keys, F.explode(items).alias("x")).select(*keys, "x.metric", "x.value")


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Long (metric, value) tables: improvement (positive is better), percent, flag."""
    j = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    d = F.col("current") - F.col("baseline")
    imp = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -d).otherwise(d)
    return j.withColumns(
        {"improvement": imp, "improvement_pct": F.when(F.col("baseline") != 0, imp / F.abs("baseline") * 100).otherwise(F.lit(0.0)), "is_better": imp > 0}
    )


def compare_versions(history: DataFrame, first: str, second: str, version: str = "version") -> DataFrame:
    """Metric differences of two versions in a long history table, one pass."""
    g = history.filter(F.col(version).isin(first, second)).groupBy("metric").agg(
        F.max(F.when(F.col(version) == first, F.col("value"))).alias("first"), F.max(F.when(F.col(version) == second, F.col("value"))).alias("second")
    ).filter("first IS NOT NULL AND second IS NOT NULL")
    d = F.col("second") - F.col("first")
    return g.withColumns({"difference": d, "pct_change": F.when(F.col("first") != 0, d / F.col("first") * 100).otherwise(F.lit(0.0))})


def promotion(comparison: DataFrame, auc_margin: float = 0.005, f1_margin: float = 0.005) -> DataFrame:
    """One row: winners by AUC and F1, and whether to promote the second version."""
    at = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("difference"))), F.lit(0.0))
    a, f = at("auc"), at("f1")
    return comparison.agg(
        a.alias("auc_difference"), f.alias("f1_difference"),
        F.when((a > 0) & (f > 0), "second").when((a <= 0) & (f <= 0), "first").otherwise("unclear").alias("recommended"),
        ((a >= auc_margin) & (f >= f1_margin)).alias("promote"),
    )


def best_run(history: DataFrame, keys: list[str]) -> DataFrame:
    """The run of the highest (AUC + F1 + (MCC+1)/2)/3 in a wide run table."""
    score = (F.col("auc") + F.col("f1") + (F.col("mcc") + 1) / 2) / 3
    return history.withColumn("score", score).agg(F.max_by(F.struct(*keys, "score"), F.struct("score", *keys)).alias("x")).select("x.*")


def upset_analysis(df: DataFrame, keys: list[str], distance: float = 0.3) -> DataFrame:
    """Confident predictions that were wrong: count and percentage of all rows."""
    wrong = (F.abs(F.col("p") - 0.5) > distance) & ((F.col("p") >= 0.5).cast("int") != F.col("y_true"))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(wrong).alias("upsets"), (F.count_if(wrong) / F.count("*") * 100).alias("upset_pct"))


def combine_perspectives(df: DataFrame, game: str, side: str, p: str) -> DataFrame:
    """p(Blue) = (p_blue + 1 - p_red) / 2 per game."""
    b, r = F.max(F.when(F.col(side) == "Blue", F.col(p))), F.max(F.when(F.col(side) == "Red", F.col(p)))
    return df.groupBy(game).agg(((b + 1 - r) / 2).alias("blue_win_prob")).withColumn("red_win_prob", 1 - F.col("blue_win_prob"))


def soft_vote(long: DataFrame, weights: DataFrame, row: str, model: str = "model") -> DataFrame:
    """Weighted mean probability per row over models (one weight row per model)."""
    j = long.join(F.broadcast(weights.select(model, "weight")), model)
    return j.groupBy(row).agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))


def vote_scores(long: DataFrame, fold: Column, model: str = "model") -> DataFrame:
    """(model, f1, auc, cv_mean, cv_std): metrics over all rows, and mean and deviation of
    AUC over folds; what weights of a vote are made from."""
    whole = report(long, [model]).select(model, "f1", "auc")
    by_fold = auc(long.withColumn("__fold", fold), [model, "__fold"]).groupBy(model).agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"))
    return whole.join(by_fold, model)


def search_weights(long: DataFrame, row: str, models: list[str], steps: int = 10, model: str = "model") -> DataFrame:
    """(weights, accuracy, brier, log_loss) of every mix of the models whose weights are
    multiples of 1 / steps and sum to 1. Rows are read once: a row's mixes are made in
    place and summed map-side; the grid has as many points as compositions of ``steps``
    in ``models``, so few models are meant."""
    def compositions(left: int, n: int):
        if n == 1:
            return [(left,)]
        return [(i, *rest) for i in range(left + 1) for rest in compositions(left - i, n - 1)]

    wide = long.groupBy(row, "y_true").agg(*[F.max(F.when(F.col(model) == m, F.col("p"))).alias(f"__{i}") for i, m in enumerate(models)])
    y, sums = F.col("y_true"), []
    grid = compositions(steps, len(models))
    for g in grid:
        p = reduce(lambda a, b: a + b, [F.col(f"__{i}") * (w / steps) for i, w in enumerate(g)])
        sums.append(F.struct(F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(log_loss_of(y, p)).alias("log_loss")))
    names = ["-".join(map(str, g)) for g in grid]
    each = wide.agg(*[s.alias(n) for n, s in zip(names, sums)])
    return each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("weights"), F.col(f"`{n}`").alias("m")) for n in names])).alias("x")).select("x.weights", "x.m.*")


def prediction_correlation(long: DataFrame, row: str, model: str = "model") -> DataFrame:
    """Pearson correlation of every pair of models over common rows: the rows of one
    id form one small array (one entry per model), no self-join."""
    per = long.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(model, "p"))).alias("a"))
    pairs = per.select(F.explode("a").alias("x"), "a").select("x", F.explode(F.filter("a", lambda z: z[model] > F.col("x")[model])).alias("y"))
    return pairs.groupBy(F.col(f"x.{model}").alias("first"), F.col(f"y.{model}").alias("second")).agg(F.corr("x.p", "y.p").alias("corr"))
