"""Drift of features and of performance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.plans.ordered import HOT_ROWS, Past, history, running, value_levels, with_totals

# Thresholds of metric drops, retraining rule.
THRESHOLDS = {"auc": 0.02, "f1": 0.03, "accuracy": 0.03, "log_loss": 0.05}
SEVERITY = ("low", "medium", "high", "critical")


def performance_drift(current: DataFrame, baseline: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Per metric: drop against the baseline and its severity. AUC and F1 have three
    grades; accuracy and log loss are high or nothing."""
    j = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    drop = F.when(F.col("metric") == "log_loss", F.col("current") - F.col("baseline")).otherwise(F.col("baseline") - F.col("current"))
    th = reduce(lambda a, kv: F.when(F.col("metric") == kv[0], F.lit(kv[1])).otherwise(a), thresholds.items(), F.lit(None).cast("double"))
    graded = F.col("metric").isin("auc", "f1")
    sev = (
        F.when(graded & (drop >= th * 2), 3).when(drop >= th, 2).when(graded & (drop >= th * 0.5), 1).otherwise(0)
    )
    return j.filter(th.isNotNull()).select("metric", "baseline", "current", drop.alias("drop"), th.alias("threshold"), sev.alias("severity_rank"))


def drift_summary(findings: DataFrame) -> DataFrame:
    """Highest severity of all findings: drift flag, severity, retraining advice."""
    top = F.coalesce(F.max("severity_rank"), F.lit(0))
    name = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), top + 1)
    urgency = F.element_at(F.array(F.lit("none"), F.lit("monitor"), F.lit("soon"), F.lit("immediate")), top + 1)
    return findings.agg(
        F.count("*").alias("findings"), (top >= 2).alias("is_drifting"), name.alias("severity"), urgency.alias("urgency"), (top >= 2).alias("should_retrain")
    )


def features_long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(items).alias("x")).select(*keep, "x.feature", "x.value").filter("value IS NOT NULL")


def psi(long: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Population stability index per key over (keys, is_current, value).

    Equal-width bins of the reference range, last bin closed, values outside
    dropped, counts smoothed by one.
    """
    ref = ~F.col("is_current")
    rng = long.groupBy(*keys).agg(
        F.min(F.when(ref, F.col("value"))).alias("lo"), F.max(F.when(ref, F.col("value"))).alias("hi"),
        F.count_if(ref).alias("nr"), F.count_if(F.col("is_current")).alias("nc"),
    ).filter("nr > 0")
    # one row per feature name: no larger than the list of columns compared
    d = long.join(F.broadcast(rng), keys)
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    step = (hi - lo) / F.lit(float(bins))
    b = reduce(lambda a, x: a + x, [(v >= lo + step * F.lit(float(i))).cast("int") for i in range(1, bins)], F.lit(0))
    counts = d.filter((v >= lo) & (v <= hi)).withColumn("bin", b).groupBy(*keys, "bin").agg(F.count_if(ref).alias("r"), F.count_if(F.col("is_current")).alias("c"))
    grid = rng.select(*keys, "nr", "nc", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    j = grid.join(counts, [*keys, "bin"], "left")
    r = (F.coalesce("r", F.lit(0)) + 1) / (F.col("nr") + bins)
    c = (F.coalesce("c", F.lit(0)) + 1) / (F.col("nc") + bins)
    return j.groupBy(*keys).agg(F.sum((c - r) * F.ln(c / r)).alias("psi"), F.max("nr").alias("reference_rows"), F.max("nc").alias("current_rows"))


def ks_statistic(long: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per key: rows -> distinct values ->
    slot prefix sums of both counts -> largest gap."""
    cells = long.groupBy(*keys, "value").agg(F.count_if(~F.col("is_current")).alias("r"), F.count_if(F.col("is_current")).alias("c"))
    tot = cells.groupBy(*keys).agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    run = running(cells, keys, value_levels("value"), ["value"], {"br": ("sum", F.col("r")), "bc": ("sum", F.col("c"))})
    gap = F.abs((F.col("br") + F.col("r")) / F.col("nr") - (F.col("bc") + F.col("c")) / F.col("nc"))
    return with_totals(run, tot, keys).groupBy(*keys).agg(F.max(gap).alias("ks"), F.first("nr").alias("reference_rows"), F.first("nc").alias("current_rows"))


def feature_drift(long: DataFrame, min_rows: int = 100, psi_limit: float = 0.1, ks_limit: float = 0.1) -> DataFrame:
    """Per feature: PSI, KS, means, deviations and the drift flag; all at once."""
    ref, cur = ~F.col("is_current"), F.col("is_current")
    m = long.groupBy("feature").agg(
        F.avg(F.when(ref, F.col("value"))).alias("reference_mean"), F.avg(F.when(cur, F.col("value"))).alias("current_mean"),
        F.stddev_samp(F.when(ref, F.col("value"))).alias("reference_std"), F.stddev_samp(F.when(cur, F.col("value"))).alias("current_std"),
    )
    p = psi(long, ["feature"]).filter((F.col("reference_rows") >= min_rows) & (F.col("current_rows") >= min_rows)).select("feature", "psi")
    k = ks_statistic(long, ["feature"]).select("feature", "ks")
    return m.join(p, "feature").join(k, "feature").withColumn("drifted", (F.col("psi") > psi_limit) | (F.col("ks") > ks_limit))


def feature_drift_summary(per_feature: DataFrame) -> DataFrame:
    share = F.avg(F.col("drifted").cast("double"))
    return per_feature.agg(
        F.count("*").alias("features"), F.count_if("drifted").alias("drifted"), share.alias("drift_share"),
        F.when(share > 0.3, "critical").when(share > 0.15, "high").when(share > 0.05, "medium").otherwise("low").alias("severity"),
    )


def decay_rate(df: DataFrame, keys: list[str], time: str, value: str, threshold: float = 0.75) -> DataFrame:
    """Least squares of a metric on days since its first point: slope per day and
    per 30 days, R2, t statistic, months until the threshold. At least 3 points.

    p-value and trend belong to the result row: see ``trend``.
    """
    if not keys:
        return decay_rate(df.withColumn("__all", F.lit(1)), ["__all"], time, value, threshold).drop("__all")
    first = df.groupBy(*keys).agg(F.min(time).alias("__t0"), F.max_by(value, time).alias("__last"), F.max(time).alias("__t1"))
    d = df.join(first, keys)
    day = (F.col(time).cast("double") - F.col("__t0").cast("double")) / 86400
    v = F.col(value)
    g = d.withColumns({"__d": day, "__dl": (F.col("__t1").cast("double") - F.col("__t0").cast("double")) / 86400}).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(v, F.col("__d")).alias("slope"), F.regr_intercept(v, F.col("__d")).alias("intercept"),
        F.coalesce(F.regr_r2(v, F.col("__d")), F.lit(0.0)).alias("r2"), F.max("__last").alias("last_value"), F.max("__dl").alias("span"),
    ).filter("n >= 3")
    r = F.sqrt("r2") * F.signum("slope")
    now = F.col("intercept") + F.col("slope") * F.col("span")
    left = (F.lit(threshold) - now) / F.col("slope")
    months = F.when((F.col("slope") < 0) & (F.col("last_value") > threshold) & (left > 0), left / 30)
    return g.withColumns(
        {"slope_per_month": F.col("slope") * 30, "t": F.when(F.col("r2") < 1, r * F.sqrt((F.col("n") - 2) / (1 - F.col("r2")))), "months_to_threshold": months}
    )


def trend(slope: float, t: float | None, n: int) -> tuple[float, str]:
    """(p-value, trend) of one result row."""
    from boutline.functions.scalar import t_two_sided

    p = 0.0 if t is None else t_two_sided(t, n - 2)
    if p > 0.05:
        return p, "stable"
    return p, "declining" if slope < -0.001 else "improving" if slope > 0.001 else "stable"


def _epsilon(n0: Column, n1: Column, var: Column, delta: float) -> Column:
    m = n0 * n1 / (n0 + n1)
    ln = math.log(2 / delta)
    return F.sqrt(F.lit(2.0) / m * var * F.lit(ln)) + F.lit(2.0) / (m * 3) * F.lit(ln)


def adaptive_cut(df: DataFrame, keys: list[str], levels: list[Column], order: list[str], value: str, delta: float = 0.002) -> DataFrame:
    """Best cut of one whole window per key: the position whose two sides differ
    most, among those beyond the bound. Prefix sums and totals only."""
    v = F.col(value)
    r = running(df, keys, levels, order, {"n0": ("sum", F.lit(1)), "s0": ("sum", v)})
    tot = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("s"), (F.var_pop(v) + F.lit(1e-10)).alias("var"))
    j = with_totals(r, tot, keys).filter((F.col("n0") >= 5) & (F.col("n0") < F.col("n") - 5))
    n0, n1 = F.col("n0").cast("double"), (F.col("n") - F.col("n0")).cast("double")
    diff = F.abs(F.col("s0") / n0 - (F.col("s") - F.col("s0")) / n1)
    hit = j.select(*keys, "n0", diff.alias("diff"), _epsilon(n0, n1, F.col("var"), delta).alias("eps")).filter("diff > eps")
    best = hit.groupBy(*keys).agg(F.max_by(F.struct("n0", "diff", "eps"), F.struct("diff", -F.col("n0"))).alias("x")).filter("x IS NOT NULL")
    return best.select(*keys, F.col("x.n0").alias("cut"), F.col("x.diff").alias("mean_difference"), F.col("x.eps").alias("epsilon"))


#: Points that a window judges together.
STRETCH = 64


@dataclass
class DyadicWindow:
    """The adaptive window of one series in logarithmic memory, a point at a time.

    A window is cut at the border whose sides differ most beyond the bound, and goes on
    after the point at the border. Borders thin out with age: at position t a border b may
    be used if it is a multiple of 2**k, where k = floor(log2((t - b) / exact)) is 0 for
    ages below 2 * ``exact``. So near borders are all there, the window of an age is
    summed in blocks of doubling size, two neighbours of which become one as they grow
    old, and a border once gone never returns: about ``exact`` * log2(n) of them are kept,
    whatever the window's length. Windows of up to 2 * ``exact`` points are cut exactly.

    A border holds the sums of values and squares before it and its own value; no point
    is read twice. Points are judged in stretches: one bound over a stretch rules out almost
    all borders at once, and only the others are judged point by point. No cut is looked for before ``2 * min_window`` points are known; then
    those from ``min_window`` on are judged, so a stream and a table agree.
    """

    delta: float = 0.002
    min_window: int = 30
    exact: int = 32
    start: int = 0
    seen: int = 0
    total: float = 0.0
    square: float = 0.0
    start_total: float = 0.0
    start_square: float = 0.0
    borders: list = field(default_factory=list)
    sums: list = field(default_factory=list)
    squares: list = field(default_factory=list)
    values: list = field(default_factory=list)
    first: list = field(default_factory=list)

    def state(self) -> tuple:
        return tuple(getattr(self, f.name) for f in fields(self)[3:])

    def _until(self, b: np.ndarray) -> np.ndarray:
        """Last position at which each border may be used: 2**k divides it for the age's k."""
        step = np.where(b == 0, 1 << 40, b & -b)
        return b + 2 * self.exact * step - 1

    def _gaps(self, b, before, n, whole, square):
        """How far the two sides of each border differ, -1 within the bound; all arguments
        but ``b`` and ``before`` may be columns with a row a position."""
        left = b - self.start
        right = n - left
        mean = whole / n
        spread = np.maximum(square / n - mean * mean, 0.0) + 1e-10
        m, ln = left * right / n, math.log(2 / self.delta)
        with np.errstate(divide="ignore", invalid="ignore"):  # borders that are still to come at a position
            gap = np.abs(before / left - (whole - before) / right)
            return np.where(gap > np.sqrt(2 / m * spread * ln) + 2 / (3 * m) * ln, gap, -1.0)

    def _open(self, b, before, n, whole, square) -> np.ndarray:
        """Places of the borders that may exceed the bound in any of the windows, which have
        ``n`` points. With E = sum before the border - mean
        of the window x points before it, and m = left x right / n, the bound reads |E| >
        sqrt(2 spread ln m) + 2 ln / 3: E lies between its values at the least and largest
        mean, and m grows with the window. The allowance is far above what rounding moves."""
        ln = math.log(2 / self.delta)
        mean = whole / n
        spread = max(float((square / n - mean * mean).min()), 0.0) + 1e-10
        left = b - self.start
        low, high = left * mean.min(), left * mean.max()
        far = np.maximum(np.abs(before - low), np.abs(before - high))
        least = np.maximum(n[0], left + 6)  # a border is judged once five points follow it
        m = left - left / least * left
        slack = 1e-9 * (1 + np.abs(before) + np.abs(low) + np.abs(high))
        return np.flatnonzero(far + slack > np.sqrt(2 * spread * ln * m) * (1 - 1e-9) + 2 / 3 * ln)

    def _stretch(self, b, own, v, total, square) -> tuple[int, int] | None:
        """(point of the stretch, place of the border) of the first cut among the points
        ``v``, the last of ``b`` and ``own``; ``total`` and ``square`` are sums up to each."""
        seen = self.seen + 1 + np.arange(len(v))
        judged = np.flatnonzero((seen > self.min_window) & (seen - self.start >= 11))
        if not len(judged):
            return None
        seen = seen[judged]
        lo, hi = np.searchsorted(b, (self.start + 5, seen[-1] - 5))
        if lo >= hi:
            return None
        n, whole, squares = seen - self.start, total[judged] - self.start_total, square[judged] - self.start_square
        before = own[0, lo:hi] - self.start_total
        open_ = self._open(b[lo:hi], before, n, whole, squares)
        if not len(open_):
            return None
        c = b[lo:hi][open_]
        gap = self._gaps(c, before[open_], n[:, None], whole[:, None], squares[:, None])
        gap[(c >= seen[:, None] - 5) | (self._until(c) < seen[:, None] - 1)] = -1.0
        hit = np.flatnonzero((gap > 0).any(axis=1))
        return (int(judged[hit[0]]), int(lo + open_[gap[hit[0]].argmax()])) if len(hit) else None

    def _walk(self, points: list[float]) -> Iterator[tuple[int, int]]:
        """Adds points, a stretch at a time; one with a cut ends at it."""
        b, own = np.asarray(self.borders, np.int64), np.asarray([self.sums, self.squares, self.values], float)
        points, at = np.asarray(points, float), 0
        while at < len(points):
            v = points[at : at + STRETCH]
            total, square = np.cumsum((self.total, *v)), np.cumsum((self.square, *(v * v)))
            wide = np.concatenate((b, self.seen + np.arange(len(v))))
            sums = np.concatenate((own, (total[:-1], square[:-1], v)), axis=1)
            cut = self._stretch(wide, sums, v, total[1:], square[1:])
            done = len(v) if cut is None else cut[0] + 1
            start = self.start
            self.total, self.square, self.seen, at = float(total[done]), float(square[done]), self.seen + done, at + done
            if cut is not None:
                k = cut[1]
                yield int(wide[k]), self.seen - start
                self.start = int(wide[k]) + 1
                self.start_total, self.start_square = float(sums[0, k] + sums[2, k]), float(sums[1, k] + sums[2, k] ** 2)
            kept = np.flatnonzero((wide >= (self.start if cut is not None else 0)) & (wide < self.seen) & (self._until(wide) >= self.seen - 1))
            b, own = wide[kept], sums[:, kept]
        self.borders, (self.sums, self.squares, self.values) = b, own

    def feed(self, values) -> list[tuple[int, int]]:
        """(position, window size) of every cut that the new points bring."""
        self.first = [*self.first, *np.asarray(values, float).tolist()]
        if self.seen + len(self.first) < 2 * self.min_window and self.seen == 0:
            return []
        points, self.first = self.first, []
        return list(self._walk(points))


def adaptive_sequence(df: DataFrame, keys: list[str], order: list[str], value: str, delta: float = 0.002, min_window: int = 30, exact: int = 32) -> DataFrame:
    """(keys..., position, window_size): cuts with restart at each drift, of any number
    of series.

    Series are dealt over tasks and come to a task in their order; a task walks through
    them batch by batch with one small window as its state, so neither a series nor a
    task's share is held. ``adaptive_cut`` judges one whole window in parallel;
    streaming.jobs.drift_stream has the same window as its state.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "position long, window_size long"])

    def run(batches):
        import pyarrow as pa

        window, at = None, None
        for batch in batches:
            turns = np.zeros(batch.num_rows, bool)
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                turns[1:] |= code[1:] != code[:-1]
            ends = [*np.flatnonzero(turns).tolist(), batch.num_rows]
            values = batch.column(value).to_numpy(zero_copy_only=False)
            found, i = [], 0
            for j in ends if batch.num_rows else ():
                name = tuple(batch.column(k)[i].as_py() for k in keys)
                if name != at:
                    window, at = DyadicWindow(delta, min_window, exact), name
                found += [(*name, *x) for x in window.feed(values[i:j])]
                i = j
            if found:
                columns = list(zip(*found))
                fixed = [pa.array(c, batch.schema.field(k).type) for k, c in zip(keys, columns)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(columns[-2], pa.int64()), pa.array(columns[-1], pa.int64())], names=[*keys, "position", "window_size"])

    dealt = df.select(*keys, *order, F.col(value).cast("double").alias(value)).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, value).mapInArrow(run, schema)


def sliding_drift(df: DataFrame, keys: list[str], levels, order: list[str], value: str, size: int = 50, step: int = 10, threshold: float = 0.1, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Means and deviations of windows of ``size`` every ``step`` rows, each against
    the window before it."""
    d, ks = (df, keys) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])
    v = F.col(value)
    h = history(d.select(*ks, *order, value), ks, [Past(ks, "_rank", frames={"__s": (F.sum, v, size - 1), "__q": (F.sum, v * v, size - 1)})], order, levels, hot_rows)
    start = F.col("_rank") - (size - 1)
    mean = (F.coalesce("__s", F.lit(0.0)) + v) / size
    sq = (F.coalesce("__q", F.lit(0.0)) + v * v) / size
    w = h.filter((start >= 0) & (start % step == 0)).select(
        *ks, (start / step).cast("long").alias("window_index"), mean.alias("mean"), F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))).alias("std")
    )
    # one row per window: the previous one is an equi-join on the index, not a window over the key
    prev = w.select(*ks, (F.col("window_index") + 1).alias("window_index"), F.col("mean").alias("mean_before"), F.col("std").alias("std_before"))
    j = w.join(prev, [*ks, "window_index"])
    diff = F.abs(F.col("mean") - F.col("mean_before"))
    pooled = F.sqrt((F.col("std") * F.col("std") + F.col("std_before") * F.col("std_before")) / 2)
    eff = F.when(pooled > 0, diff / pooled).otherwise(F.lit(0.0))
    return j.select(
        *keys, "window_index", "mean_before", F.col("mean").alias("mean_after"), eff.alias("effect_size"),
        ((eff > threshold * 5) | (diff > threshold)).alias("is_drift"),
    )


def retrain_trigger(
    runs: DataFrame, data_rows: Column, now: Column, cooldown_hours: float = 4, force_days: int = 30, min_new: int = 500,
    schedule: str = "weekly", weekday: int = 0, month_day: int = 1, hour: int = 2,
) -> DataFrame:
    """One row: whether and why to retrain, from a run history (ts, rows).

    ``weekday`` counts from Monday = 0; a schedule is due from ``hour`` on.
    """
    last = runs.agg(F.max("ts").alias("last_ts"), F.coalesce(F.max_by("rows", "ts"), F.lit(0)).alias("last_rows"))
    hours = (now.cast("double") - F.col("last_ts").cast("double")) / 3600
    days = F.floor(hours / 24)
    due = {
        "daily": F.to_date("last_ts") < F.to_date(now),
        "weekly": (days >= 7) & (F.weekday(now) == weekday),
        "monthly": (F.date_trunc("month", F.col("last_ts")) != F.date_trunc("month", now)) & (F.dayofmonth(now) == month_day),
    }[schedule] & (F.hour(now) >= hour)
    reason = (
        F.when(F.col("last_ts").isNull(), "initial")
        .when(hours < cooldown_hours, "cooldown").when(days >= force_days, "forced").when(due, "schedule")
        .when(data_rows - F.col("last_rows") >= min_new, "new_data").otherwise("none")
    )
    return last.select(reason.alias("reason"), (~reason.isin("cooldown", "none")).alias("should_retrain"))
