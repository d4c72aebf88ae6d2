"""Exact search for the highest inner products with a pivot-distance index.

Vectors get one coordinate more, the root of what their squared length lacks of the
longest one's (queries get 0). Then the distance of a query and a vector falls exactly as
their inner product rises, and the triangle inequality bounds products:

1. Pivots are the centres of a few rounds of k-means on a bounded sample
   (``SAMPLE_ROWS`` rows of smallest hash). Every vector is keyed by its nearest pivot and
   its distance to it.
2. The distances of a pivot, in at most ``BINS`` bins, are cut into sorted annuli of about
   ``cell_rows`` vectors; an annulus that holds more (copies share a distance) is dealt
   over several cells.
3. A query first searches the cell that it lies in itself; its k-th score tells how far
   an annulus may be to hold anything as good. Then it expands to the few annuli with the
   best bounds, and at last to all that may still hold a result; within a cell, vectors
   are taken by bound and the search stops as soon as no bound reaches the k-th score.

Every row is indexed and every cell is searched or excluded by a bound, so results are
exact. Queries are dealt over chunks, so neither a cell nor those who visit it grow with
the tables.

Defined cases: vectors that are null, hold null or non-finite components, have no id, or
are so long that scores leave 64 bits (squared length over 2**62 after scaling) take no
part; vectors of another number of components have no score with a query; rows equal in
id and vector count once; a row with the query's id is its own, whatever its vector; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.session import cut_lineage

SAMPLE_ROWS = 4096
PIVOTS = 64
BINS = 1024
#: Bytes of the vectors of a cell, and queries that visit it at once.
CELL_BYTES = 1 << 22
CHUNK_QUERIES = 1 << 14
#: Annuli that a query visits between its own and all the rest.
NEAR = 8
#: Vectors of a cell that are scored at once.
STEP = 1024
_SLACK = 1e-6

KEYED = "dim int, pivot int, dist double, vec_id long, vec array<int>, asks boolean"
FOUND = "query_id long, qkey long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), F.transform(wide, lambda x: F.floor(scale * x)))


def _squared(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest - (vectors**2).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T
    return np.sqrt(np.maximum(0.0, square))


def centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Up to ``n`` centres of the sample: far points first, then k-means."""
    chosen = [0]
    least = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(sample, sample[chosen[-1:]])[:, 0])
    found = sample[chosen]
    for _ in range(rounds):
        home = _distances(sample, found).argmin(axis=1)
        count = np.bincount(home, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        found = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], found)
    return found


def _by_pivot(pivots: dict[int, np.ndarray], longest: float):
    """Keys each vector by its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = t.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 1 << 13):
                    some = part.slice(at, 1 << 13)
                    far = _distances(_lifted(_matrix(some.column("vec"), dim), longest), pivots[dim])
                    near = far.argmin(axis=1)
                    yield pa.record_batch(
                        {
                            "dim": pa.array([dim] * some.num_rows, pa.int32()),
                            "pivot": pa.array(near.astype(np.int32)),
                            "dist": pa.array(far[np.arange(len(near)), near]),
                            "vec_id": some.column("vec_id").combine_chunks(),
                            "vec": some.column("vec").combine_chunks().cast(pa.list_(pa.int32())),
                            "asks": some.column("asks").combine_chunks(),
                        }
                    )

    return run


def _best(ids: np.ndarray, scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    first = np.searchsorted(rows[order], rows[order], "left")
    return order[np.arange(len(order)) - first < k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they hold all sums."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_cell(ids, vectors, far, queries, own, away, at_least, longest, k):
    """The k best of a cell for each query as (query's place, id, score).

    ``far`` and ``away`` are the distances of the vectors (ascending) and of the queries
    to the cell's pivot, ``own`` the queries' ids, ``at_least`` the scores that results
    must reach, ``longest`` the squared length that all vectors were lifted to."""
    n, m = len(queries), len(ids)
    low = at_least.copy()
    best_row, best_id, best_score = (np.zeros(0, np.int64) for _ in range(3))
    # a query's bound is on the square of its distance: |q|^2 + longest - 2 * score
    base = (queries**2).sum(axis=1) + longest
    steps = [(i, min(i + STEP, m)) for i in range(0, m, STEP)]
    gaps = np.stack([np.maximum(0.0, np.maximum(far[a] - away, away - far[b - 1])) for a, b in steps], axis=1)
    bound = (base[:, None] - gaps**2) / 2 + _SLACK * (1 + np.abs(base))[:, None]
    for s in np.argsort(-bound.max(axis=0), kind="stable").tolist():
        open_ = np.flatnonzero(bound[:, s] >= low)
        if not len(open_):
            continue
        a, b = steps[s]
        for q in range(0, len(open_), 512):
            who = open_[q : q + 512]
            score = _products(queries[who], vectors[a:b])
            ok = (score >= low[who][:, None]) & (ids[a:b][None, :] != own[who][:, None])
            if b - a > k:
                masked = np.where(ok, score, np.iinfo(np.int64).min)
                ok &= score >= np.partition(masked, b - a - k, axis=1)[:, b - a - k][:, None]
            r, c = np.nonzero(ok)
            best_row = np.concatenate([best_row, who[r]])
            best_id = np.concatenate([best_id, ids[a:b][c]])
            best_score = np.concatenate([best_score, score[r, c]])
        keep = _best(best_id, best_score, best_row, k)
        best_row, best_id, best_score = best_row[keep], best_id[keep], best_score[keep]
        full = np.flatnonzero(np.bincount(best_row, minlength=n) == k)
        worst = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(worst, best_row, best_score)
        low[full] = np.maximum(low[full], worst[full])
    return best_row, best_id, best_score


def _visit(longest: float, k: int):
    """Searches a cell for the queries of a chunk that visit it."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "qkey": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = key[0].as_py()
        cell = left.sort_by([("dist", "ascending"), ("vec_id", "ascending")])
        ids, far, vectors = cell.column("vec_id").to_numpy(), cell.column("dist").to_numpy(), _matrix(cell.column("vec"), dim)
        same = np.zeros(len(ids), bool)  # equal rows are neighbours in this order
        same[1:] = (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
        ids, far, vectors = ids[~same], far[~same], vectors[~same]
        queries, own = _matrix(right.column("vec"), dim), right.column("query_id").to_numpy()
        away, low = right.column("away").to_numpy(), right.column("low").to_numpy()
        row, vec_id, score = search_cell(ids, vectors, far, queries, own, away, low, longest, k)
        return pa.table({"query_id": pa.array(own[row]), "qkey": right.column("qkey").take(pa.array(row)), "vec_id": pa.array(vec_id), "score": pa.array(score)})

    return run


def _with_reach(pivots: dict[int, np.ndarray], longest: float):
    """Adds the distances of each query, its last coordinate 0, to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = t.filter(pa.array(dims == dim))
                v = _matrix(part.column("vec"), dim)
                to = _distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), pivots[dim])
                lists = pa.ListArray.from_arrays(np.arange(0, to.size + 1, to.shape[1], dtype=np.int32), pa.array(to.ravel()))
                far = pa.array((v**2).sum(axis=1) + longest)
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in part.columns], lists, far], names=[*part.schema.names, "to", "base"])

    return run


CELL = ["dim", "pivot", "ring", "part"]
_LEAST = -(1 << 63)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, cell_bytes: int = CELL_BYTES, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with
    all other rows, on components floor(scale * x)."""
    taken = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    taken = taken.filter("vec_id IS NOT NULL AND vec IS NOT NULL").withColumns({"dim": F.size("vec"), "square": _squared(F.col("vec"))})
    taken = taken.filter((F.col("square") <= float(1 << 62)) & ~F.exists("vec", lambda x: F.abs(x) >= (1 << 31)))
    found = taken.select("vec_id", F.transform("vec", lambda x: x.cast("int")).alias("vec"), "asks", "dim", "square")
    stats = found.agg(F.max("square").alias("longest"), F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asked")).first()
    spark = vectors.sparkSession
    if not stats.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = float(stats.longest)
    hashed = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = found.select("dim", "vec", F.row_number().over(hashed).alias("turn")).filter(F.col("turn") <= SAMPLE_ROWS).toArrow()
    dims = sample.column("dim").to_numpy()
    pivots = {d: centres(_lifted(_matrix(sample.filter(pa.array(dims == d)).column("vec"), d), longest), PIVOTS) for d in np.unique(dims).tolist()}

    keyed = cut_lineage(found.select("dim", "vec_id", "vec", "asks").mapInArrow(_by_pivot(pivots, longest), KEYED))
    # at most dimensions x PIVOTS x BINS rows: bins of each pivot, joined to annuli
    rows_of = F.greatest(F.lit(1), F.floor(F.lit(cell_bytes) / (4 * (F.col("dim") + 1))))
    width = 2 * longest**0.5 / BINS or 1.0
    bins = keyed.groupBy("dim", "pivot", F.floor(F.col("dist") / width).alias("bin")).agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    before = Window.partitionBy("dim", "pivot").orderBy("bin")
    bins = bins.withColumn("ring", F.floor((F.sum("n").over(before) - F.col("n")) / rows_of))
    bins = cut_lineage(bins)
    rings = bins.groupBy("dim", "pivot", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / rows_of).cast("int"))
    home = keyed.withColumn("bin", F.floor(F.col("dist") / width)).join(F.broadcast(bins.select("dim", "pivot", "bin", "ring")), ["dim", "pivot", "bin"]).drop("bin")
    home = home.join(F.broadcast(rings.select("dim", "pivot", "ring", "parts")), ["dim", "pivot", "ring"])
    cells = cut_lineage(home.select("dim", "pivot", "ring", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "dist", "vec", "asks"))

    chunks = max(1, -(-(stats.asked or 0) // chunk_queries))
    asked = cells.filter("asks").dropDuplicates(["vec_id", "vec"])
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("qkey"), "vec", *CELL, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))
    fields = "query_id long, qkey long, vec array<int>, dim int, pivot int, ring long, part int, chunk int, to array<double>, base double"
    queries = cut_lineage(asked.mapInArrow(_with_reach(pivots, longest), fields))

    def search(visits: DataFrame) -> DataFrame:
        """Results of visits (a query's fields with a cell and the score to reach)."""
        key = [*CELL, "chunk"]
        need = visits.select(*key).distinct()
        left = cells.drop("asks").join(need, CELL).groupBy(*key)
        fields = visits.select(*[F.col(c).alias(c) for c in (*key, "query_id", "qkey", "vec", "away", "low")])  # new columns, apart from the left ones
        right = fields.groupBy(*key)
        return left.cogroup(right).applyInArrow(_visit(longest, k), FOUND)

    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")

    def ranked(*parts: DataFrame) -> DataFrame:
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        return cut_lineage(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))

    def with_low(q: DataFrame, hits: DataFrame) -> DataFrame:
        """The score that a further result must reach, and how far its annulus may be."""
        low = hits.filter(F.col("rank") == k).select("query_id", "qkey", F.col("score").alias("low"))
        out = q.join(low, ["query_id", "qkey"], "left").withColumn("low", F.coalesce("low", F.lit(_LEAST)))
        far = F.col("base") * (1 + 2 * _SLACK) + 2 * _SLACK - 2 * F.col("low").cast("double")
        return out.withColumn("radius", F.sqrt(F.greatest(F.lit(0.0), far)))

    def annuli(q: DataFrame) -> DataFrame:
        """Each query with every annulus that its radius meets, by gap, without its own cell."""
        at = q.withColumnsRenamed({"pivot": "own_pivot", "ring": "own_ring", "part": "own_part"})
        at = at.select("*", F.posexplode("to").alias("pivot", "away"))
        gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("away"), F.col("away") - F.col("hi"))
        met = at.join(F.broadcast(rings), ["dim", "pivot"]).withColumn("gap", gap).filter(F.col("gap") <= F.col("radius") * (1 + _SLACK) + _SLACK)
        met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return met.filter(~((F.col("pivot") == F.col("own_pivot")) & (F.col("ring") == F.col("own_ring")) & (F.col("part") == F.col("own_part"))))

    def visits(pairs: DataFrame) -> DataFrame:
        return pairs.join(queries.select("query_id", "qkey", "vec"), ["query_id", "qkey"])

    columns = ["query_id", "qkey", *CELL, "chunk", "away", "low", "gap"]
    first = ranked(search(queries.withColumns({"low": F.lit(_LEAST), "away": F.get("to", F.col("pivot"))})))
    nearest = Window.partitionBy("query_id", "qkey").orderBy("gap", *CELL)
    near = annuli(with_low(queries, first)).select(*columns).withColumn("turn", F.row_number().over(nearest)).filter(F.col("turn") <= NEAR)
    near = cut_lineage(near)
    second = ranked(first.drop("rank"), search(visits(near)))
    rest = annuli(with_low(queries, second)).select(*columns).join(near.select("query_id", "qkey", *CELL), ["query_id", "qkey", *CELL], "left_anti")
    last = ranked(second.drop("rank"), search(visits(rest)))
    return last.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
