"""Near-duplicate documents: b-bit MinHash with exact confirmation.

1. One pass over the texts makes, for each, its set of word shingles, 128 minima, keys
   of 32 bands of four minima, and the low two bits of all minima, packed.
2. Documents with equal sets are one class from here on (a grouped minimum).
3. Every band bucket links its members to a hub, the member with the most company over
   all its bands. Links are confirmed on the full sets.
4. A hub and all that share a bucket with it are a neighbourhood. Where it still holds
   more than one component, nodes outside the hub's are held against all its nodes, block
   against block: the packed bits give a similarity, corrected for chance agreement, and
   nodes with a likely partner in another component are compared on their full sets.
   Every pair of different components that shares a bucket is judged; only links leave a
   block, one for each node and component, never pairs of a group.

A pair at the threshold shares a bucket with probability 1 - (1 - 0.75**4)**32 > 1 - 6e-6,
and its estimate stays above threshold - margin but for about one pair in a million.

Defined cases: null, empty or blank texts have no shingles and are linked with nothing;
texts with fewer than five words have one shingle, their whole sequence; rows that share
a doc_id are one node: its texts are linked through it, and each row is returned; a null
doc_id takes no part (component_id null, kept true); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm import hashing
from boutline.plans.bounded import bounded
from boutline.session import cut_lineage

SHINGLE = 5
PERMUTATIONS, BANDS, BITS = 128, 32, 2
ROWS = PERMUTATIONS // BANDS
THRESHOLD_PCT = 75
MARGIN = 0.2
CHUNK = 1024

_random = np.random.default_rng(20240229)
_FACTOR = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[hashing.Words, np.ndarray, np.ndarray]]:
    """(slice, hashes of shingles, offsets of texts in them); a text of fewer than five
    words has its whole sequence, one without words nothing. Repeats are not removed."""
    for w in hashing.words(texts, lower=True):
        counts = w.counts
        own = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
        offsets = np.concatenate([[0], np.cumsum(own)])
        out = np.empty(offsets[-1], np.uint64)
        full = hashing.whole(w.offsets, SHINGLE)
        first = np.repeat(offsets[:-1] - w.offsets[:-1], counts)
        out[full + first[full]] = hashing.windows(w.hashes, SHINGLE)[full]
        for n in range(1, SHINGLE):
            at = np.flatnonzero(counts == n)
            if len(at):
                out[offsets[:-1][at]] = hashing.windows(w.hashes, n)[w.offsets[:-1][at]]
        yield w, out, offsets


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, shingles, offsets in shingle_sets(batch.column("text")):
            n = w.last - w.first
            filled = np.flatnonzero(np.diff(offsets))
            at = offsets[:-1][filled]
            sizes, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for d in filled:
                distinct = np.unique(shingles[offsets[d] : offsets[d + 1]])
                sizes[d] = len(distinct)
                one[d], two[d] = hashing.mixed(distinct, 1).sum(), hashing.mixed(distinct, 2).sum()
            minima = np.empty((len(filled), PERMUTATIONS), np.uint64)
            if len(filled):
                for k in range(PERMUTATIONS):
                    minima[:, k] = np.minimum.reduceat(shingles * _FACTOR[k] + _SHIFT[k], at)
            minima >>= np.uint64(32)
            keys = np.zeros((len(filled), BANDS), np.uint64)
            for r in range(ROWS):
                keys = hashing.mixed(keys + minima[:, r::ROWS], r)
            keys = hashing.mixed(keys ^ np.arange(BANDS, dtype=np.uint64))
            low = (minima & np.uint64((1 << BITS) - 1)).astype(np.uint8)
            packed = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, -BITS:].reshape(len(filled), PERMUTATIONS * BITS), axis=1)
            bands, bits = [None] * n, [None] * n
            for row, d in enumerate(filled):
                bands[d], bits[d] = keys[row].view(np.int64), packed[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(w.first, n), batch.column("text_hash").slice(w.first, n), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set1", "set2", "bands", "bits"],
            )


def _distinct_sets(texts: pa.Array) -> list[np.ndarray]:
    found = []
    for w, shingles, offsets in shingle_sets(texts):
        found += [np.unique(shingles[offsets[d] : offsets[d + 1]]) for d in range(w.last - w.first)]
    return found


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose shingle sets are similar enough."""
    for batch in batches:
        left, right = _distinct_sets(batch.column("text_a")), _distinct_sets(batch.column("text_b"))
        keep = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= THRESHOLD_PCT * (len(x) + len(y) - both) and both > 0)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links. Only small batches of pairs are in memory."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the smallest label that links (a, b) reach. Labels
    spread over links and then along themselves, so a chain of n links takes about log n
    rounds. Nodes with one label count as linked."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("b", "node"), "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("to"))
        spread = cut_lineage(spread)
        via = cut_lineage(spread.groupBy("was").agg(F.min("to").alias("via")).filter("via < was"))
        if not via.limit(1).count():
            return labels
        once = spread.join(bounded(via), "was", "left").select("node", F.least("to", F.coalesce("via", "to")).alias("to"))
        twice = once.join(bounded(via.withColumnRenamed("was", "to")), "to", "left")
        labels = cut_lineage(twice.select("node", F.coalesce("via", "to").alias("label")))


def _bit_block(x: pa.Table, y: pa.Table) -> pa.Table:
    """Of two blocks of a neighbourhood, the nodes that have a partner in another
    component whose estimated similarity is not below the threshold less the margin."""
    chance = 1 / (1 << BITS)

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, PERMUTATIONS * BITS // 64)
        return t.column("node").to_numpy(), t.column("label").to_numpy(), bits

    (xn, xl, xb), (yn, yl, yb) = columns(x), columns(y)
    x_in, y_in = np.zeros(len(xn), bool), np.zeros(len(yn), bool)
    for i in range(len(xn) if len(yn) else 0):
        differ = yb ^ xb[i]
        odd = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
        agree = 1 - np.bitwise_count(odd).sum(axis=1) / PERMUTATIONS
        fit = ((agree - chance) / (1 - chance) >= THRESHOLD_PCT / 100 - MARGIN) & (yl != xl[i])
        x_in[i] = fit.any()
        y_in |= fit
    hub = (x if x.num_rows else y).column("hub")[0].as_py() if x.num_rows or y.num_rows else 0
    nodes = np.unique(np.concatenate([xn[x_in], yn[y_in]]))
    return pa.table({"hub": pa.array(np.full(len(nodes), hub, np.int64)), "node": pa.array(nodes, pa.int64())})


def _set_block(x: pa.Table, y: pa.Table) -> pa.Table:
    """Links between two blocks: for each node of ``x`` one to every other component of
    ``y`` that has a similar enough set. All intersections at once are a product of two
    incidence matrices over the shingles that both blocks have."""

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sets = t.column("shingles").combine_chunks()
        counts = np.diff(sets.offsets.to_numpy()) if t.num_rows else np.zeros(0, np.int64)
        return t.column("node").to_numpy(), t.column("label").to_numpy(), sets.flatten().to_numpy(), counts, np.repeat(np.arange(t.num_rows), counts)

    (xn, xl, xs, xc, xr), (yn, yl, ys, yc, yr) = columns(x), columns(y)
    both = np.zeros((len(xn), len(yn)), np.float32)
    common = np.intersect1d(xs, ys)
    for i in range(0, len(common), 4096):
        part = common[i : i + 4096]

        def incidence(values: np.ndarray, rows: np.ndarray, n: int, part: np.ndarray = part) -> np.ndarray:
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], at[hit]] = 1
            return m

        both += incidence(xs, xr, len(xn)) @ incidence(ys, yr, len(yn)).T
    linked = (100 * both >= THRESHOLD_PCT * (xc[:, None] + yc[None, :] - both)) & (both > 0) & (xl[:, None] != yl[None, :])
    a, b = [], []
    for i in np.flatnonzero(linked.any(axis=1)):
        at = np.flatnonzero(linked[i])
        _, first = np.unique(yl[at], return_index=True)
        a.append(np.full(len(first), xn[i]))
        b.append(yn[at[first]])
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})


def block_pairs(members: DataFrame, payload: str, weight: str):
    """Blocks of nodes outside the main component of their neighbourhood, cogrouped with
    every block of the same neighbourhood. ``members``: (hub, node, label, main, others);
    a block has about ``CHUNK`` nodes and a bounded sum of ``weight``."""
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(weight) / (CHUNK * 1024))).cast("long")
    sized = members.groupBy("hub").agg(parts.alias("parts"))
    y = members.join(sized, "hub").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    x = y.filter("label <> main")
    x_parts = x.groupBy("hub").agg(F.collect_set("part").alias("x_parts"))
    xs = x.select("hub", F.col("part").alias("xp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("yp"), "node", "label", payload)
    ys = y.join(x_parts, "hub").select(F.explode("x_parts").alias("xp"), F.col("part").alias("yp"), *(F.col(c).alias(c) for c in ("hub", "node", "label", payload)))
    return xs.groupBy("hub", "xp", "yp").cogroup(ys.groupBy("hub", "xp", "yp"))


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in _distinct_sets(batch.column("text"))]
        rest = [batch.column(c) for c in ("hub", "node", "label", "main", "n_shingles")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.list_(pa.int64()))], ["hub", "node", "label", "main", "n_shingles", "shingles"])


def other_links(around: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a neighbourhood ``around`` (hub, node)."""
    now = around.join(labels, "node")
    own = F.max(F.when(F.col("node") == F.col("hub"), F.col("label")))
    open_hubs = now.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), own.alias("main")).filter("lo < hi").select("hub", "main")
    mixed = cut_lineage(now.join(open_hubs, "hub").join(nodes.select("node", "bits", "n_shingles"), "node"))
    likely = cut_lineage(block_pairs(mixed.withColumn("one", F.lit(1)), "bits", "one").applyInArrow(_bit_block, "hub long, node long").distinct())
    few = mixed.drop("bits").join(likely, ["hub", "node"], "left_semi").join(texts, "node")
    sets = cut_lineage(few.select("hub", "node", "label", "main", "n_shingles", "text").mapInArrow(_node_sets, "hub long, node long, label long, main long, n_shingles long, shingles array<long>"))
    return block_pairs(sets, "shingles", "n_shingles").applyInArrow(_set_block, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, bands array<long>, bits binary"
    signed = cut_lineage(rows.mapInArrow(_signatures, schema).withColumn("node", F.when(F.col("n_shingles") > 0, F.xxhash64("set1", "set2"))))

    # a node is a set of shingles; the smallest document with it lends it name and text
    named = signed.filter("doc_id is not null and node is not null")
    nodes = named.groupBy("node").agg(F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "bands", "bits"), F.struct("doc_id", "text_hash")).alias("s"))
    nodes = cut_lineage(nodes.select("node", "s.*"))

    buckets = nodes.select("node", F.explode("bands").alias("key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(buckets.join(crowded, "key"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = shared.join(company, "node")
    hubs = ranked.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    members = cut_lineage(shared.select("key", "node").join(hubs, "key"))
    need = bounded(cut_lineage(nodes.join(company, "node", "left_semi").select("node", "doc_id", "text_hash")))
    texts = cut_lineage(rows.dropna(subset=["doc_id"]).join(need, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]))

    around = cut_lineage(members.select("hub", "node").distinct())
    pairs = around.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = cut_lineage(confirmed(pairs, texts))
    # texts of one doc_id are one document
    ties = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a < hi").select("doc_id", "a")
    ties = named.join(ties, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    labels = components(nodes.select("node", F.col("doc_id").alias("label")), links.union(ties))
    labels = components(labels, other_links(around, labels, nodes, texts))
    out = signed.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that a smaller doc_id of their
    component replaces; of rows that repeat a doc_id, one stays."""
    judged = cut_lineage(near_duplicates(docs))
    gone = cut_lineage(judged.filter("not kept").select(F.col("doc_id").alias("_id")).distinct())
    left = docs.join(bounded(gone), docs["doc_id"].cast("long") == F.col("_id"), "left_anti")
    often = cut_lineage(judged.filter("kept").dropna(subset=["doc_id"]).groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id"))
    if not often.limit(1).count():
        return left
    same = left["doc_id"].cast("long") == F.col("_id")
    return left.join(bounded(often), same, "left_anti").unionByName(left.join(bounded(often), same, "left_semi").dropDuplicates(["doc_id"]))
