"""Bagged trees on binned rows: all trees of all folds grown together, one scan a level.

The method and its settings are those of Spark's ``RandomForestClassifier`` for two classes:
borders at quantiles, Poisson bootstrap, a random subset of features for each node, Gini,
leaves of one parent with one prediction merged, mean share of the leaves as probability.
What differs is the work. A tree sees of a row its bins and its label, so rows that share
these are one cell with a count, whose weight in a tree is drawn as Poisson of the count:
the sum of the draws of its rows. Borders come from quantiles of every row (Spark takes
10,000 rows). A level of all trees is one job: a task adds up the histograms of its
cells, a group of one tree's histograms picks the splits, and only splits and class counts
reach the driver (trees x nodes). Where no rows are alike, cells are the rows and the
job stays linear in them.

Folds are fits of the same rows: a fit learns from the rows outside its fold, with its own
borders. Draws are seeded by a cell's block, so runs agree whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutline.session import cut_lineage

#: Quantiles of a feature that borders are chosen from.
GRID = 10_000
#: Cells that are multiplied out at once, and the least number of blocks of a fit.
BLOCK_CELLS = 32_768
LEAST_BLOCKS = 32


CELLS = "fit int, cell binary, n long"
BLOCKS = "fit int, block int, cells binary, n binary"
SUMS = "fit int, tree int, sums array<double>"
PICKED = "fit int, tree int, feature array<int>, cut array<int>, total array<double>, left array<double>"


@dataclass(frozen=True)
class Bins:
    """Borders of each fit and feature; bin b holds border b - 1 < x <= border b."""

    features: list[str]
    borders: list[list[np.ndarray]]

    @property
    def most(self) -> int:
        return 1 + max((len(b) for fit in self.borders for b in fit), default=0)

    @property
    def width(self) -> int:
        """Bytes of a cell: its bins, its label, and zeros up to whole words."""
        return -(-(len(self.features) + 1) // 8) * 8

    def of(self, fit: int, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, i]) for i, b in enumerate(self.borders[fit])], axis=1).astype(np.uint8)


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
    if np.isnan(x).any():
        raise ValueError("features hold null or NaN")
    return x


def pick_borders(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Spark's rule: between all values if they are few, else where the weight below
    comes nearest to equal shares."""
    v, at = np.unique(values, return_inverse=True)
    middle = (v[:-1] + v[1:]) / 2
    middle = np.where(middle < v[1:], middle, v[:-1])  # of neighbouring doubles it may round to the larger
    if len(v) <= bins:
        return middle
    below = np.cumsum(np.bincount(at, weights))
    stride = below[-1] / bins
    out, target = [], stride
    for i in range(1, len(v)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[: bins - 1])


def find_bins(df: DataFrame, features: list[str], bins: int = 32, fold: str | None = None, folds: int = 1) -> Bins:
    """Borders from quantiles of every row, one aggregate of all features and folds."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    at = F.split(F.lit(",".join(str((i + 0.5) / GRID) for i in range(GRID))), ",").cast("array<double>")
    part = (F.col(fold) if fold else F.lit(0)).alias("part")
    parts = df.groupBy(part).agg(F.count("*").alias("n"), *[F.percentile_approx(F.col(c).cast("double"), at, GRID).alias(f"q{i}") for i, c in enumerate(features)]).collect()
    out = []
    for k in range(folds):
        seen = [r for r in parts if not fold or r["part"] != k]
        if not seen or any(r[f"q{i}"] is None for r in seen for i in range(len(features))):
            raise ValueError("no rows to learn from, or a feature without values")
        weights = np.concatenate([np.full(GRID, r["n"] / GRID) for r in seen])
        out.append([pick_borders(np.concatenate([np.array(r[f"q{i}"]) for r in seen]), weights, bins) for i in range(len(features))])
    return Bins(list(features), out)


def cells(df: DataFrame, bins: Bins, label: str = "result", fold: str | None = None) -> DataFrame:
    """(fit, cell, n): training rows of each fit by their bins and label, a byte each."""
    names, width = bins.features, bins.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch, names), batch.column("label").to_numpy(zero_copy_only=False)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels are 0 or 1")
            for k in range(len(bins.borders)):
                use = part != k
                key = np.zeros((int(use.sum()), width), np.uint8)
                key[:, : len(names)] = bins.of(k, x[use])
                key[:, len(names)] = y[use]
                u, n = np.unique(key.view(np.uint64 if width == 8 else f"V{width}").ravel(), return_counts=True)
                ends = pa.py_buffer(np.arange(len(u) + 1, dtype=np.int32) * np.int32(width))
                got = pa.Array.from_buffers(pa.binary(), len(u), [None, ends, pa.py_buffer(u.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), got, pa.array(n.astype(np.int64))], ["fit", "cell", "n"])

    d = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("int").alias("label"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("part"))
    return cut_lineage(d.mapInArrow(count, CELLS).groupBy("fit", "cell").agg(F.sum("n").alias("n")))


def _blocks(counted: DataFrame, fits: int) -> DataFrame:
    """Cells packed into blocks by their hash, in order, one row a block."""
    b = max(LEAST_BLOCKS, -(-counted.count() // (BLOCK_CELLS * fits)))

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by("cell")
        raw, n = b"".join(t.column("cell").to_pylist()), t.column("n").to_numpy().astype(np.int64).tobytes()
        return pa.table({"fit": t.column("fit")[:1], "block": t.column("block")[:1], "cells": pa.array([raw], pa.binary()), "n": pa.array([n], pa.binary())})

    keyed = counted.withColumn("block", F.pmod(F.xxhash64("cell"), F.lit(b)).cast("int"))
    return keyed.repartition(b, "fit", "block").groupBy("fit", "block").applyInArrow(pack, BLOCKS)


def _walk(feature: np.ndarray, split: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Node (root 0, children 2 i + 1 and 2 i + 2) that each row of bins comes to."""
    at, flat, first = np.zeros(len(x), np.int32), x.ravel(), np.arange(len(x), dtype=np.int32) * np.int32(x.shape[1])
    for _ in range(depth):
        f = feature[at]
        down = f >= 0
        if not down.any():
            break
        at = np.where(down, 2 * at + 1 + (flat[first + np.maximum(f, 0)] > split[at]), at)
    return at


def _gini(c: np.ndarray) -> np.ndarray:
    share = c / np.maximum(c.sum(axis=-1, keepdims=True), 1)
    return 1 - (share * share).sum(axis=-1)


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From class counts (node, candidate, bin, class): candidate (-1: none) and bin of
    the best split of each node, class counts of the node and of its left child."""
    left = hist.cumsum(axis=2)
    total, left = left[:, 0, -1, :], left[:, :, :-1, :]
    right = total[:, None, None, :] - left
    n, nl, nr = total.sum(axis=-1)[:, None, None], left.sum(axis=-1), right.sum(axis=-1)
    n1 = np.maximum(n, 1)
    gain = np.where((nl > 0) & (nr > 0), _gini(total)[:, None, None] - nl / n1 * _gini(left) - nr / n1 * _gini(right), -1.0)
    flat = gain.reshape(len(hist), -1)
    if not flat.shape[1]:
        return np.full(len(hist), -1), np.zeros(len(hist), int), total, total
    best, rows = flat.argmax(axis=1), np.arange(len(hist))
    candidate, cut = best // gain.shape[2], best % gain.shape[2]
    return np.where(flat[rows, best] > 0, candidate, -1), cut, total, left[rows, candidate, cut]


def _sums(feature, split, chosen, level: int, width: int, label: int, most: int, drawn: bool, seed: int):
    """Class counts of a task's cells at the level's open nodes, by tree: (node, candidate, bin, class)."""
    trees, nodes, m = chosen.shape[1:]
    first = 2**level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, block, raw, n in zip(*[c.to_pylist() for c in batch.columns]):
                cell, n = np.frombuffer(raw, np.uint8).reshape(-1, width), np.frombuffer(n, np.int64)
                rng = np.random.default_rng([seed, k, block])
                into = held.setdefault(k, np.zeros((trees, nodes * m * most * 2)))
                for t in range(trees):
                    w = rng.poisson(n) if drawn else n
                    at = _walk(feature[k, t], split[k, t], cell, level) - first
                    use = np.flatnonzero((at >= 0) & (w > 0))
                    node = at[use]
                    slot = (node[:, None] * m + np.arange(m)) * most + cell[use[:, None], chosen[k, t][node]]
                    into[t] += np.bincount((slot * 2 + cell[use, label, None]).ravel(), np.repeat(w[use], m), minlength=into.shape[1])
        for k, h in held.items():
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t], pa.int32()), pa.array([h[t]], pa.list_(pa.float64()))], ["fit", "tree", "sums"])

    return run


def _pick(chosen, most: int):
    """Adds up a tree's class counts and picks the split of each of its open nodes."""

    def run(table: pa.Table) -> pa.Table:
        k, t = table.column("fit")[0].as_py(), table.column("tree")[0].as_py()
        mine = chosen[k, t]
        total = sum(row.values.to_numpy() for row in table.column("sums"))
        candidate, cut, total, left = best_splits(total.reshape(*mine.shape, most, 2))
        f = np.where(candidate < 0, -1, mine[np.arange(len(mine)), candidate])
        row = {"feature": f.astype(np.int32), "cut": cut.astype(np.int32), "total": total.ravel(), "left": left.ravel()}
        return pa.table({"fit": table.column("fit")[:1], "tree": table.column("tree")[:1], **{c: pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype))) for c, v in row.items()}})

    return run


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (fit, tree, node): feature (-1: leaf), bin that still goes left, share of ones."""

    bins: Bins
    feature: np.ndarray
    split: np.ndarray
    share: np.ndarray
    depth: int

    def scores(self, fit: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, s, p in zip(self.feature[fit], self.split[fit], self.share[fit]):
            out += p[_walk(f, s, x, self.depth)]
        return out / len(self.feature[fit])

    def predict(self, df: DataFrame, keep: list[str], label: str = "result", fold: str | None = None) -> DataFrame:
        """(keep..., y_true, p); with ``fold``, each row by the fit that did not see it."""
        names, model = self.bins.features, self
        d = df.select(*keep, F.col(label).alias("y_true"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("__fit"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(names)])
        n_out = len(keep) + 1

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, fit = _matrix(batch, [f"__x{i}" for i in range(len(names))]), batch.column("__fit").to_numpy()
                p = np.empty(len(x))
                for k in np.unique(fit):
                    mine = np.flatnonzero(fit == k)
                    u, at = np.unique(model.bins.of(k, x[mine]), axis=0, return_inverse=True)
                    p[mine] = model.scores(k, u)[at.ravel()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_out], pa.array(p)], [*batch.schema.names[:n_out], "p"])

        return d.mapInArrow(score, T.StructType([*d.schema.fields[:n_out], T.StructField("p", T.DoubleType())]))


@dataclass(frozen=True)
class OnBins:
    """A model whose features are the bins of a row (fit 0)."""

    bins: Bins
    model: object

    def predict(self, df: DataFrame, keep: list[str], label: str = "result") -> DataFrame:
        """(keep..., y_true, p)."""
        names, bins = self.bins.features, self.bins
        d = df.select(*keep, F.col(label).alias("y_true"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(names)])
        n_out = len(keep) + 1

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = bins.of(0, _matrix(batch, [f"__x{i}" for i in range(len(names))]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_out], _lists(b)], [*batch.schema.names[:n_out], "__bins"])

        rows = d.mapInArrow(put, T.StructType([*d.schema.fields[:n_out], T.StructField("__bins", T.ArrayType(T.DoubleType()))]))
        scored = self.model.transform(rows.withColumn("features", array_to_vector("__bins")))
        return scored.select(*d.columns[:n_out], vector_to_array("probability")[1].alias("p"))


def _lists(b: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(b) + 1, dtype=np.int32) * np.int32(b.shape[1]))
    return pa.ListArray.from_arrays(ends, pa.array(b.ravel().astype(float)))


def boost(counted: DataFrame, bins: Bins, learner: GBTClassifier, label: str = "result") -> OnBins:
    """Spark's boosted trees on the ``cells`` of one fit, weighted by their counts. Trees see
    bins only, so they are those of the rows; Spark samples rows for its borders beyond
    bins squared rows, so it is allowed enough bins to take each border found here."""
    width, d = bins.width, len(bins.features)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(-1, width)
            n = batch.column("n").to_numpy().astype(float)
            yield pa.RecordBatch.from_arrays([_lists(cell[:, :d]), pa.array(cell[:, d].astype(np.int32)), pa.array(n)], ["__bins", label, "__n"])

    rows = counted.filter("fit = 0").mapInArrow(unpack, f"__bins array<double>, `{label}` int, __n double")
    enough = max(learner.getMaxBins(), int(np.ceil(np.sqrt(counted.count()))) + 1)
    fitted = learner.copy({learner.weightCol: "__n", learner.maxBins: enough}).fit(rows.withColumn("features", array_to_vector("__bins")))
    return OnBins(bins, fitted)


def covers_boosting(learner) -> bool:
    """Whether ``boost`` does what this learner's settings ask for."""
    return (
        isinstance(learner, GBTClassifier) and learner.getSubsamplingRate() == 1 and learner.getMinInstancesPerNode() == 1 and learner.getMaxBins() <= 256
        and not learner.isSet("weightCol") and not learner.isSet("validationIndicatorCol") and not learner.isSet("thresholds")
    )


def covers(learner) -> bool:
    """Whether ``grow`` does what this learner's settings ask for."""
    return (
        isinstance(learner, RandomForestClassifier) and learner.getImpurity() == "gini" and learner.getMinInstancesPerNode() == 1
        and learner.getMinInfoGain() == 0 and learner.getMinWeightFractionPerNode() == 0 and learner.getSubsamplingRate() == 1
        and learner.getMaxBins() <= 256 and learner.getFeatureSubsetStrategy() in ("auto", "all", "sqrt") and not learner.isSet("weightCol")
        and not learner.isSet("thresholds")
    )


def grow(counted: DataFrame, bins: Bins, learner: RandomForestClassifier) -> Forest:
    """A forest for each fit of ``cells``, with the learner's settings."""
    trees, depth, seed, drawn = learner.getNumTrees(), learner.getMaxDepth(), learner.getSeed() % 2**63, learner.getBootstrap()
    fits, n_features, most = len(bins.borders), len(bins.features), bins.most
    strategy = learner.getFeatureSubsetStrategy()
    m = n_features if strategy == "all" or (strategy == "auto" and trees == 1) else int(np.ceil(np.sqrt(n_features)))
    width, size = bins.width, 2 ** (depth + 1) - 1
    feature, split = np.full((fits, trees, size), -1, np.int16), np.zeros((fits, trees, size), np.uint8)
    counts = np.zeros((fits, trees, size, 2))
    blocks = cut_lineage(_blocks(counted, fits))

    for level in range(max(depth, 1)):
        nodes, first, any_split = 2**level, 2**level - 1, False
        chosen = np.stack([np.sort(np.random.default_rng([seed, k, level]).random((trees, nodes, n_features)).argsort(axis=-1)[..., :m], axis=-1) for k in range(fits)])

        work = blocks.mapInArrow(_sums(feature.copy(), split.copy(), chosen, level, width, n_features, most, drawn, seed), SUMS)
        for r in work.groupBy("fit", "tree").applyInArrow(_pick(chosen, most), PICKED).collect():
            k, t, f = r["fit"], r["tree"], np.array(r["feature"])
            total, left = np.array(r["total"]).reshape(nodes, 2), np.array(r["left"]).reshape(nodes, 2)
            if level == 0:
                counts[k, t, 0] = total[0]
            if depth == 0:
                continue
            done = np.flatnonzero(f >= 0)
            any_split = any_split or len(done) > 0
            at = first + done
            feature[k, t, at], split[k, t, at] = f[done], np.array(r["cut"])[done]
            counts[k, t, 2 * at + 1], counts[k, t, 2 * at + 2] = left[done], total[done] - left[done]
        if not any_split:
            break

    ones = counts[..., 1] > counts[..., 0]
    for i in range((size - 1) // 2 - 1, -1, -1):  # leaves of one parent and one prediction are merged
        a, b = 2 * i + 1, 2 * i + 2
        alike = (feature[..., i] >= 0) & (feature[..., a] < 0) & (feature[..., b] < 0) & (ones[..., a] == ones[..., b])
        feature[..., i][alike] = -1
    n = counts.sum(axis=-1)
    return Forest(bins, feature, split, np.where(n > 0, counts[..., 1] / np.maximum(n, 1), 0.5), depth)
