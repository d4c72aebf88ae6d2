"""Bootstrap of prediction metrics on score cells.

Drawing n rows with replacement gives the rows of one (score, label) cell together a
Poisson weight whose mean is their number. So rows are read once and reduced to cells,
and a replicate draws one weight a cell: work follows cells x replicates. Cells are
ordered by score and cut into slots; a slot's task makes all replicates of its cells and
returns sums only, and AUC needs no more than the negatives in the slots before.

A weight comes from a hash of key, cell number, label and replicate: up to
``TABLE_ROWS`` rows by the inverse Poisson distribution, beyond by its normal limit.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.plans.ordered import ranked, value_levels

TABLE_ROWS = 32
SLOT_CELLS = 4096
SUMS = ["pos", "neg", "tp", "fp", "squares", "pairs"]
_BLOCK = 256


def poisson_table(n: int) -> np.ndarray:
    """Cumulative probabilities of 0, 1, .. of Poisson(n), far beyond 32 bits."""
    return np.cumsum([math.exp(-n + k * math.log(n) - math.lgamma(k + 1)) for k in range(2 * n + 41)])


def draws(names: list[str], counts: np.ndarray, replicates: int) -> np.ndarray:
    """Weights (cells x replicates) of cells with these numbers of rows. One digest
    serves two replicates: 32 bits each for the two numbers that a draw may take."""
    pairs = (replicates + 1) // 2
    raw = b"".join(hashlib.md5(f"{name}-{g}".encode()).digest() for name in names for g in range(pairs))
    u = ((np.frombuffer(raw, ">u4").astype(np.float64) + 0.5) / 4294967296.0).reshape(len(names), 2 * pairs, 2)[:, :replicates]
    out = np.zeros((len(names), replicates), np.int64)
    for n in np.unique(counts[(counts > 0) & (counts <= TABLE_ROWS)]).tolist():
        at = counts == n
        out[at] = np.searchsorted(poisson_table(n), u[at, :, 0], "right")
    large = counts > TABLE_ROWS
    n = counts[large].astype(np.float64)[:, None]
    normal = np.sqrt(-2 * np.log(u[large, :, 0])) * np.cos(2 * math.pi * u[large, :, 1])
    out[large] = np.maximum(0, np.floor(n + np.sqrt(n) * normal + 0.5)).astype(np.int64)
    return out


def _slot(keys: list[str], replicates: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = "-".join(str(k.as_py()) for k in key[:-1])
        cells = table.sort_by("cell")
        sums = {c: np.zeros(replicates) for c in SUMS}
        for at in range(0, cells.num_rows, _BLOCK):
            b = cells.slice(at, _BLOCK)
            p, number = b.column("p").to_numpy()[:, None], b.column("cell").to_pylist()
            pos, neg = (draws([f"{name}-{i}-{y}" for i in number], b.column(c).to_numpy(), replicates) for c, y in (("n_pos", 1), ("n_neg", 0)))
            before = np.cumsum(neg, axis=0) - neg + sums["neg"]
            sums["pairs"] += (pos * (before + neg / 2)).sum(axis=0)
            sums["squares"] += (pos * (1 - p) ** 2 + neg * p**2).sum(axis=0)
            hit = p[:, 0] >= 0.5
            sums["tp"] += pos[hit].sum(axis=0)
            sums["fp"] += neg[hit].sum(axis=0)
            sums["pos"] += pos.sum(axis=0)
            sums["neg"] += neg.sum(axis=0)
        own = {k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip([*keys, "slot"], key)}
        return pa.table({**own, **{c: pa.array([v], pa.list_(pa.float64())) for c, v in sums.items()}})

    return run


def bootstrap(df: DataFrame, keys: list[str], replicates: int = 1000, slot_cells: int = SLOT_CELLS) -> DataFrame:
    """(keys..., replicate, accuracy, f1, brier, auc) of (keys..., y_true 0/1, p)."""
    cells = df.groupBy(*keys, "p").agg(F.sum("y_true").cast("long").alias("n_pos"), F.sum(1 - F.col("y_true")).cast("long").alias("n_neg"))
    cells = ranked(cells, keys, value_levels("p"), ["p"], "cell").withColumn("slot", F.floor(F.col("cell") / slot_cells))
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in [*keys, "slot"]], *[f"{c} array<double>" for c in SUMS]])
    slots = cells.groupBy(*keys, "slot").applyInArrow(_slot(keys, replicates), schema)
    each = slots.select(*keys, "slot", F.posexplode(F.arrays_zip(*SUMS)).alias("replicate", "s")).select(*keys, "slot", "replicate", "s.*")
    earlier = Window.partitionBy(*keys, "replicate").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    g = each.withColumn("pairs", F.col("pairs") + F.col("pos") * below).groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in SUMS])
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    n = pos + neg
    return g.filter(n > 0).select(
        *keys, "replicate", ((tp + neg - fp) / n).alias("accuracy"), F.when(tp + fp + pos > 0, 2 * tp / (tp + fp + pos)).otherwise(0.0).alias("f1"),
        (F.col("squares") / n).alias("brier"), F.when((pos > 0) & (neg > 0), F.col("pairs") / (pos * neg)).alias("auc"),
    )
