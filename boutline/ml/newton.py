"""Many penalised logistic regressions fitted together, one scan of the rows a step.

Folds, training shares, split strategies and penalties make dozens or hundreds of fits of
the same rows. Each Newton step of all of them is one job: a task keeps, for every fit
that has not settled, the gradient and the weighted Gram matrix of its rows (sums of
fixed size, added up as a grouped aggregate), and the new coefficients of a fit are
solved from its sums in the group's task. A Gram matrix serves for further steps as long
as each brings the gradient down tenfold, since a gradient costs a fraction of it. Fits of
one penalty (at the first step, from 0, of any) whose subsets overlap share one, scaled by
rows; a fit that it does not serve gets its own. The optimum is judged by the gradient, so
what the matrices are taken from does not move it. Coefficients and Gram matrices come to
the driver: fits x features squared numbers. Rows are never copied, whatever the number of fits, since a fit names
the subset that it learns from and a row holds one flag a subset.

The objective is that of ``training.fit_logistic``: balanced class weights n / (2 n_class)
of the subset, features scaled by the subset's mean and sample deviation (constant ones
stay out), penalty 1 / C times (1 - a) / 2 |g|^2 + a |g|_1 on the scaled coefficients g.
With an L1 part the step minimises the quadratic model by coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.session import cut_lineage

SUMS = "key int, part int, values array<double>"
#: Rows of a task that are multiplied out at once, and task sums added by one group.
CHUNK_ROWS = 2048
GROUP_TASKS = 256
#: What a step must leave of the gradient at most for its Gram matrix to be used again.
KEEP_GRAM = 0.1
#: Part of a subset's rows that another must have for its Gram matrix to stand for both, and
#: Gram matrices up to which each is a product of its own.
OVERLAP = 0.5
FEW_GRAMS = 16
#: Flags in one number of a row.
WORD_FLAGS = 62
#: Steps of the grid on which scores meet in :func:`held_metrics`.
SCORE_BINS = 8192


@dataclass(frozen=True)
class Fit:
    """One model: where it learns, its C and the share of the L1 penalty."""

    name: str
    subset: str
    c: float = 1.0
    l1_share: float = 0.0


@dataclass
class Fitted:
    """Coefficients in the features' own units, and how near to the optimum they are:
    ``gradient`` is the largest weighted mean gradient of a scaled coefficient, with its
    penalty (for a coefficient held at 0 by L1, what exceeds the penalty)."""

    fits: list[Fit]
    features: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    gradient: np.ndarray
    steps: int
    means: np.ndarray
    deviations: np.ndarray
    rows: np.ndarray
    class_weights: np.ndarray

    def table(self, spark) -> DataFrame:
        """(fit, feature, coefficient), the intercept under its own name."""
        rows = [(f.name, n, float(v)) for f, b, a in zip(self.fits, self.coefficients, self.intercepts) for n, v in [*zip(self.features, b), ("intercept", a)]]
        return spark.createDataFrame(rows, "fit string, feature string, coefficient double")


def _bits(name: str, flags: list[Column]) -> list[Column]:
    """Flags as bits of numbers <name>_0 and so on; null is unset."""
    words = [flags[i : i + WORD_FLAGS] for i in range(0, len(flags), WORD_FLAGS)]
    bit = lambda c, i: F.when(c, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return [reduce(lambda a, b: a.bitwiseOR(b), [bit(c, i) for i, c in enumerate(w)]).alias(f"{name}_{k}") for k, w in enumerate(words)]


def _inputs(s: int, *names: str) -> list[str]:
    return ["x", "y", *(f"{n}_{k}" for n in names for k in range(-(-s // WORD_FLAGS)))]


def design(rows: DataFrame, features: list[str], subsets: dict[str, tuple[Column, Column]], label: str = "result", keep: list[str] | None = None) -> DataFrame:
    """The rows as (keep..., y, x, learns_<k>, held_<k>), written once: per subset a bit
    whether the row is learnt from and one whether it is judged on. A null feature is an error."""
    number = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast("double")).otherwise(F.col(c).cast("double"))
    flags = [c for i, n in enumerate(("learns", "held")) for c in _bits(n, [pair[i] for pair in subsets.values()])]
    return cut_lineage(rows.select(*(keep or []), F.col(label).cast("double").alias("y"), F.array(*[number(c) for c in features]).alias("x"), *flags))


def _grid(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _flags(batch: pa.RecordBatch, name: str, s: int) -> np.ndarray:
    at = np.arange(min(s, WORD_FLAGS))
    words = [(batch.column(f"{name}_{k}").to_numpy()[:, None] >> at) & 1 for k in range(-(-s // WORD_FLAGS))]
    return np.concatenate(words, axis=1)[:, :s].astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch], d: int, s: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            b = batch.slice(at, CHUNK_ROWS)
            yield b, _grid(b.column("x"), d), b.column("y").to_numpy(), _flags(b, "learns", s)


def _sums(keys, values: list[np.ndarray]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId() // GROUP_TASKS
    return pa.record_batch({"key": pa.array(list(keys), pa.int32()), "part": pa.array([part] * len(values), pa.int32()), "values": pa.array(values, pa.list_(pa.float64()))})


def _moments(d: int, s: int):
    """Per subset: rows, positives, sums and squares of the features, rows shared with each subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s, 2 + 2 * d + s))
        for _, x, y, learns in _chunks(batches, d, s):
            m = learns.astype(np.float64)
            total += np.concatenate([m.sum(axis=0)[:, None], (m.T @ y)[:, None], m.T @ x, m.T @ (x * x), m.T @ m], axis=1)
        yield _sums(range(s), list(total))

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = np.stack(table.column("values").to_numpy()).sum(axis=0)
    return pa.table({"key": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "values": pa.array([total], pa.list_(pa.float64()))})


def _logistic(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def _derivatives(d: int, s: int, live: list[int], beta: np.ndarray, shift: np.ndarray, scale: np.ndarray, subset: np.ndarray, weights: np.ndarray, rows: np.ndarray, owner: dict[int, int]):
    """Per live fit: loss and gradient at ``beta``; for those with an ``owner`` (the fit
    whose Gram matrix stands for theirs) also the upper half of that, scaled by rows."""
    first, second = np.triu_indices(d + 1)
    made = sorted(set(owner.values()))
    at = [live.index(k) for k in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, gram = np.zeros(len(live)), np.zeros((len(live), d + 1)), np.zeros((len(made), len(first)))
        whole = np.zeros((len(made), d + 1, d + 1))
        of = subset[live]
        for _, x, y, learns in _chunks(batches, d, s):
            z = np.concatenate([(x - shift) / scale, np.ones((len(x), 1))], axis=1)
            eta = z @ beta[live].T
            small = np.exp(-np.abs(eta))
            p = np.where(eta >= 0, 1.0, small) / (1 + small)
            w = learns[:, of] * np.where(y[:, None] == 1, weights[of, 1], weights[of, 0])
            loss += (w * (np.maximum(eta, 0) + np.log1p(small) - y[:, None] * eta)).sum(axis=0)
            grad += (w * (p - y[:, None])).T @ z
            if made:
                curve = w[:, at] * p[:, at] * (1 - p[:, at])
                if len(made) > FEW_GRAMS:
                    gram += curve.T @ (z[:, first] * z[:, second])
                else:
                    for i in range(len(made)):
                        own = np.flatnonzero(curve[:, i])
                        whole[i] += (z[own] * curve[own, i, None]).T @ z[own]
        gram += whole[:, first, second]
        yield _sums(live, [np.concatenate([[loss[i]], grad[i], gram[made.index(owner[k])] * (rows[subset[k]] / rows[subset[owner[k]]]) if k in owner else []]) for i, k in enumerate(live)])

    return run


def _owners(wanted: list[int], kin: list[tuple], subset: np.ndarray, rows: np.ndarray, shared: np.ndarray, alone: set[int]) -> dict[int, int]:
    """Of each wanted fit, the one whose Gram matrix it gets: the largest of its ``kin``
    that holds ``OVERLAP`` of its rows, or itself, as always for those ``alone``."""
    owner: dict[int, int] = {}
    for k in sorted(wanted, key=lambda k: (-rows[subset[k]], k)):
        near = [o for o in dict.fromkeys(owner.values()) if kin[o] == kin[k] and shared[subset[k], subset[o]] >= OVERLAP * rows[subset[k]]]
        owner[k] = k if k in alone or not near else near[0]
    return owner


def penalised_step(g: np.ndarray, h: np.ndarray, beta: np.ndarray, unit: np.ndarray, l2: float, l1: float) -> np.ndarray:
    """Minimises the quadratic model of the loss plus the penalties on beta * unit (the
    last coefficient is free). With L1 by feature-sign search: the coefficients that are
    not 0 keep their signs while a linear system is solved for them; where one would
    change its sign the best point on the way is taken, and a coefficient at 0 joins if
    its slope exceeds the penalty. Ends at the exact minimum after finitely many signs."""
    d = len(beta) - 1
    ridge = np.append(l2 * unit**2, 0.0)
    full = h + np.diag(ridge + 1e-12 * max(1.0, np.trace(h)))
    slope = g + ridge * beta
    if l1 == 0:
        return beta - np.linalg.solve(full, slope)
    cost = np.append(l1 * unit, 0.0)
    at_zero = slope - full @ beta
    value = lambda x: x @ (full @ x) / 2 + at_zero @ x + cost @ np.abs(x)
    x, sign = beta.copy(), np.sign(beta)
    sign[d] = 0.0
    active = x != 0
    active[d] = True
    for _ in range(50 * (d + 1)):
        own = np.flatnonzero(active)
        to = x.copy()
        to[own] = np.linalg.solve(full[np.ix_(own, own)], -(at_zero[own] + cost[own] * sign[own]))
        turned = own[(sign[own] != 0) & (np.sign(to[own]) != sign[own])]
        if len(turned):
            step = to - x
            shares = np.unique(np.append(np.clip(-x[turned] / np.where(step[turned] == 0, 1.0, step[turned]), 0.0, 1.0), 1.0))
            points = []
            for t in shares:
                y = x + t * step
                y[turned[np.abs(y[turned]) < 1e-15 * (1 + np.abs(x[turned]))]] = 0.0
                points.append(y)
            x = min(points, key=value)
            sign[own] = np.sign(x[own])
            sign[d] = 0.0
            active = x != 0
            active[d] = True
            continue
        x = to
        pull = full @ x + at_zero
        over = np.where(active, 0.0, np.abs(pull) - cost)
        j = int(over.argmax())
        if over[j] <= 1e-12 * max(1.0, float(cost.max())):
            break
        active[j], sign[j] = True, -np.sign(pull[j])
    return x


def _unsettled(g: np.ndarray, beta: np.ndarray, unit: np.ndarray, l2: float, l1: float, n: float) -> float:
    """Largest violation of the optimality conditions, as a mean over rows."""
    slope = np.append(g[:-1] / unit + l2 * beta[:-1] * unit, g[-1])
    pull = np.append(np.full(len(unit), l1), 0.0)
    at = np.where(beta != 0, np.abs(slope + np.sign(beta) * pull), np.maximum(np.abs(slope) - pull, 0.0))
    return float(at.max()) / max(1.0, n)


def _solve(d: int, fits: list[Fit], beta, units, rows, subset, before, worth, grams: dict[int, np.ndarray]):
    """Adds a fit's sums and takes its step; halves the last one if it went too far. Gives
    violation, objective, whether the coefficients stand, the next ones, and the Gram
    matrix if it is new; else that of ``grams`` is used."""
    first, second = np.triu_indices(d + 1)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        total = np.stack(table.column("values").to_numpy()).sum(axis=0)
        g, h = total[1 : d + 2], np.zeros((d + 1, d + 1))
        fresh = total[d + 2 :]
        h[first, second] = h[second, first] = fresh if len(fresh) else grams[k]
        f, b, unit = fits[k], beta[k], units[subset[k]]
        l2, l1 = (1 - f.l1_share) / f.c, f.l1_share / f.c
        cost = total[0] + l2 / 2 * ((b[:-1] * unit) ** 2).sum() + l1 * np.abs(b[:-1] * unit).sum()
        stands = not cost > worth[k] + 1e-10 * max(1.0, abs(worth[k]))
        nxt = penalised_step(g, h, b, unit, l2, l1) if stands else (b + before[k]) / 2
        values = [_unsettled(g, b, unit, l2, l1, rows[subset[k]]), cost, float(stands), *nxt, *fresh]
        return pa.table({"key": pa.array([k], pa.int32()), "part": pa.array([0], pa.int32()), "values": pa.array([values], pa.list_(pa.float64()))})

    return run


def fit_many(rows: DataFrame, features: list[str], subsets: list[str], fits: list[Fit], tolerance: float = 1e-8, most: int = 40) -> Fitted:
    """All ``fits`` on rows of :func:`design`, whose subsets had these names in this order.
    A subset without rows of both classes gives coefficients of 0."""
    d, s = len(features), len(subsets)
    narrow = rows.select(*_inputs(s, "learns"))
    tasks = narrow.mapInArrow(_moments(d, s), SUMS).groupBy("key", "part").applyInArrow(_added, SUMS)
    moments, groups = np.zeros((s, 2 + 2 * d + s)), 1
    for r in tasks.toLocalIterator():
        moments[r.key] += np.array(r["values"])
        groups = max(groups, r.part + 1)
    n, pos, shared = moments[:, 0], moments[:, 1], moments[:, 2 + 2 * d :]
    some = np.maximum(n, 1.0)[:, None]
    means = moments[:, 2 : 2 + d] / some
    spread = np.sqrt(np.maximum(0.0, moments[:, 2 + d : 2 + 2 * d] / some - means**2) * some / np.maximum(some - 1, 1))
    spread[spread < 1e-9 * np.maximum(1.0, np.abs(means))] = 0.0
    weights = np.stack([n / (2 * np.maximum(n - pos, 1)), n / (2 * np.maximum(pos, 1))], axis=1)
    shift, scale = means.mean(axis=0), spread.mean(axis=0)
    scale[scale == 0] = 1.0
    units = np.where(spread > 0, spread, scale) / scale
    subset = np.array([subsets.index(f.subset) for f in fits])

    beta = np.zeros((len(fits), d + 1))
    before, worth, off = beta.copy(), np.full(len(fits), np.inf), np.zeros(len(fits))
    kin = [(f.c, f.l1_share) for f in fits]
    same = lambda j, k: kin[j] == kin[k] and shared[subset[j], subset[k]] == n[subset[j]] == n[subset[k]]
    twin = [next(j for j in range(k + 1) if same(j, k)) for k in range(len(fits))]  # fits of the same rows are one
    live = [k for k in range(len(fits)) if twin[k] == k and 0 < pos[subset[k]] < n[subset[k]]]
    steps, grams, alone = 0, {}, set()
    owner = _owners(live, [()] * len(fits), subset, n, shared, alone)  # all coefficients are 0
    while live and steps < most:
        steps += 1
        sums = narrow.mapInArrow(_derivatives(d, s, live, beta, shift, scale, subset, weights, n, owner), SUMS)
        if groups > 1:
            sums = sums.groupBy("key", "part").applyInArrow(_added, SUMS)
        open_, nxt, anew = [], beta.copy(), set()
        kept = {k: g for k, g in grams.items() if k in live and k not in owner}
        for r in sums.groupBy("key").applyInArrow(_solve(d, fits, beta, units, n, subset, before, worth, kept), SUMS).toLocalIterator():
            k, v = r.key, np.array(r["values"])
            if len(v) > d + 4:
                grams[k] = v[d + 4 :]
            if not v[2] or (steps > 1 and v[0] > KEEP_GRAM * off[k]):
                anew.add(k)
            if v[2]:
                off[k], worth[k], before[k] = v[0], v[1], beta[k]
                if v[0] < tolerance:
                    continue
            nxt[k] = v[3 : d + 4]
            open_.append(k)
        lent = {k: lent[k] for k in live if k in lent} | owner if steps > 1 else dict(owner)
        alone |= {k for k in anew if lent[k] != k and lent[k] not in anew}  # it served its owner, not this fit
        beta, live = nxt, sorted(open_)
        owner = _owners([k for k in live if k in anew], kin, subset, n, shared, alone)
    beta[live] = before[live]
    beta, off = beta[twin], off[twin]
    raw = beta[:, :d] / scale
    raw[spread[subset] == 0] = 0.0
    return Fitted(list(fits), list(features), raw, beta[:, d] - raw @ shift, off, steps, means[subset], spread[subset], n[subset], weights[subset])


def _score(fitted: Fitted, subset: np.ndarray, s: int, keep: list[str], parts: tuple[str, ...]):
    d = len(fitted.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, y, learns in _chunks(batches, d, s):
            held = _flags(b, "held", s)
            p = _logistic(x @ fitted.coefficients.T + fitted.intercepts)
            for k, f in enumerate(fitted.fits):
                for part, flags in (("train", learns), ("held", held)):
                    if part not in parts:
                        continue
                    at = np.flatnonzero(flags[:, subset[k]])
                    if len(at):
                        own = [b.column(c).take(pa.array(at)) for c in keep]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([f.name] * len(at)), pa.array([part] * len(at)), pa.array(y[at].astype(np.int32)), pa.array(p[at, k])], names=[*keep, "fit", "part", "y_true", "p"])

    return run


def scores(rows: DataFrame, fitted: Fitted, subsets: list[str], keep: list[str] | None = None, parts: tuple[str, ...] = ("train", "held")) -> DataFrame:
    """(keep..., fit, part, y_true, p): rows of each fit's subset, learnt from or held, of
    the ``parts`` that are wanted."""
    keep = keep or []
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "fit string, part string, y_true int, p double"])
    subset = np.array([subsets.index(f.subset) for f in fitted.fits])
    return rows.select(*keep, *_inputs(len(subsets), "learns", "held")).mapInArrow(_score(fitted, subset, len(subsets), keep, parts), schema)


def _binned(fitted: Fitted, subset: np.ndarray, s: int):
    d = len(fitted.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: dict[tuple[int, int], np.ndarray] = {}
        lost: dict[tuple[int, int], float] = {}
        for b, x, y, learns in _chunks(batches, d, s):
            eta = x @ fitted.coefficients.T + fitted.intercepts
            place = np.minimum((_logistic(eta) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
            loss = np.logaddexp(0, eta) - y[:, None] * eta
            for part, flags in enumerate((learns, _flags(b, "held", s))):
                for k in range(len(fitted.fits)):
                    own = flags[:, subset[k]]
                    at = place[own, k] * 2 + (y[own] == 1)
                    key = (k, part)
                    pos[key] = pos.get(key, 0) + np.bincount(at, minlength=2 * SCORE_BINS)
                    lost[key] = lost.get(key, 0.0) + float(loss[own, k].sum())
        for (k, part), count in pos.items():
            at = np.flatnonzero(count)
            yield pa.record_batch({"fit": pa.array([fitted.fits[k].name] * (len(at) + 1)), "part": pa.array([("train", "held")[part]] * (len(at) + 1)), "bin": pa.array([*(at // 2), -1], pa.int32()), "y": pa.array([*(at % 2), 0], pa.int32()), "n": pa.array([*count[at], 0], pa.int64()), "loss": pa.array([*np.zeros(len(at)), lost[(k, part)]])})

    return run


def held_metrics(rows: DataFrame, fitted: Fitted, subsets: list[str]) -> DataFrame:
    """(fit, part, rows, auc, accuracy, f1, log_loss) of every fit from one scan. Scores
    meet on a grid of 1/8192, so AUC counts pairs within a step as ties; the rest is exact."""
    subset = np.array([subsets.index(f.subset) for f in fitted.fits])
    cells = rows.select(*_inputs(len(subsets), "learns", "held")).mapInArrow(_binned(fitted, subset, len(subsets)), "fit string, part string, bin int, y int, n long, loss double")
    by_bin = cells.groupBy("fit", "part", "bin").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"), F.sum("loss").alias("loss"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("fit", "part").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = F.col("bin") >= SCORE_BINS // 2
    g = by_bin.withColumn("u", F.col("pos") * (below + F.col("neg") / 2)).groupBy("fit", "part").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("u").alias("u"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum("loss").alias("loss"),
    )
    tp, fp, p = (F.col(c).cast("double") for c in ("tp", "fp", "P"))
    f1 = F.when(tp + fp + p > 0, 2 * tp / (tp + fp + p)).otherwise(F.lit(0.0))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N")))
    return g.select("fit", "part", "rows", auc.alias("auc"), ((tp + F.col("N") - fp) / F.col("rows")).alias("accuracy"), f1.alias("f1"), (F.col("loss") / F.col("rows")).alias("log_loss"))


def optimality(rows: DataFrame, fitted: Fitted, subsets: list[str]) -> DataFrame:
    """(fit, feature, rows, gradient): the conditions of the optimum, evaluated from the
    rows and the coefficients alone, by JVM expressions. For each fit and scaled feature
    the weighted mean gradient with its penalty; 0 at the optimum."""
    names = [*fitted.features, "intercept"]
    parts = []
    for k, f in enumerate(fitted.fits):
        word, bit = divmod(subsets.index(f.subset), WORD_FLAGS)
        own = F.col(f"learns_{word}").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0
        beta, mean, dev = (np.asarray(v[k], float).tolist() for v in (fitted.coefficients, fitted.means, fitted.deviations))
        lit = lambda v: F.array(*[F.lit(x) for x in v])
        eta = F.aggregate(F.zip_with("x", lit(beta), lambda a, b: a * b), F.lit(float(fitted.intercepts[k])), lambda a, b: a + b)
        w0, w1 = (float(v) for v in fitted.class_weights[k])
        miss = F.when(F.col("y") == 1, w1).otherwise(w0) * (1 / (1 + F.exp(-eta)) - F.col("y"))
        scaled = F.zip_with(F.zip_with("x", lit(mean), lambda a, b: a - b), lit(dev), lambda a, b: F.when(b > 0, a / b).otherwise(0.0))
        terms = rows.filter(own).select(miss.alias("r"), F.concat(scaled, F.array(F.lit(1.0))).alias("z")).select(F.posexplode("z").alias("j", "v"), "r")
        g = terms.groupBy("j").agg(F.count("*").alias("rows"), F.sum(F.col("v") * F.col("r")).alias("g"))
        gamma = F.get(lit([*[b * v for b, v in zip(beta, dev)], 0.0]), F.col("j"))
        l2, l1 = (1 - f.l1_share) / f.c, f.l1_share / f.c
        slope = F.col("g") + l2 * gamma
        pull = F.when(F.col("j") < len(beta), l1).otherwise(0.0)
        at = F.when(gamma != 0, slope + F.signum(gamma) * pull).otherwise(F.signum(slope) * F.greatest(F.abs(slope) - pull, F.lit(0.0)))
        parts.append(g.select(F.lit(f.name).alias("fit"), F.get(lit(names), F.col("j")).alias("feature"), "rows", (at / F.col("rows")).alias("gradient")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
