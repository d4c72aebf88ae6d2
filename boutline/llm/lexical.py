"""Ranked lexical search by pipelined term partitioning.

Documents are cut into ranges (an Arrow batch of whole texts each) and terms are owned by
successive stages, rare ones first. Items travel in bundles: a bundle is with one range at
a time and carries, for each of its items, a sparse accumulator of document scores. Each
stage's owner joins it by cogroup with the postings of its terms in that range, adds
their whole-number contributions and hands it on. After the last stage a range reports
its best documents of each item, and the best of all ranges are selected.

An accumulator stays short without losing a result: after each stage, a document is
carried on only if its score and the most that all later stages could add (from the
largest tf and the shortest document of each posting list) reach the k-th score that the
range has already. As a common term comes last, it rarely opens new accumulators.

A range's postings of one term are one row, so a term in every document is dealt over all
ranges; bundles bound how many items meet a range in one task. Scores are 64-bit.

Defined cases: null texts and texts without a term never match; a null doc_id ranks after
all others among equal scores; every row of the documents is a document of its own, so
repeated rows may all be listed; items equal in id and text are one, items with a null or
termless text find nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm import hashing
from boutline.plans.bounded import bounded, within
from boutline.session import cut_lineage

#: What separates terms: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A stage owns the terms found in at most this share of documents (and no earlier stage's).
OWNERS = (1 / 512, 1 / 64, 1 / 8, 1.0)
#: Items of one bundle, documents of one range, distinct item terms looked up in the tasks.
BUNDLE_ITEMS = 512
RANGE_ROWS = 1 << 14
TERM_ROWS = 500_000

BLOCKS = "span long, term string, docs array<int>, tf array<int>, most_tf long, least_n long, n array<long>, ids array<long>"
BUNDLES = "span long, bundle int, item_id long, ikey long, docs array<int>, scores array<long>, rest array<long>"


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All terms of the texts, and the place of the text that each is in."""
    data, offsets = hashing.buffers(texts)
    lower = hashing.lower(data[offsets[0] : offsets[-1]])  # Arrow's own kernel misreads slices
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(lower))
    lists = pc.split_pattern_regex(plain, SEPARATORS)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return parents.filter(full).to_numpy(zero_copy_only=False).astype(np.int64), flat.filter(full)


def _postings(wanted: list[str] | None):
    """Rows of one range: its documents (term null: n and ids) and its postings by term.
    Documents are numbered by ascending doc_id, null last."""
    known = None if wanted is None else pa.array(wanted, pa.large_string())

    def block(span: int, batch: pa.Table) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(batch, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        batch = batch.take(order)
        texts = batch.column("text").combine_chunks()
        _, offsets = hashing.buffers(texts)
        n, docs, names, tfs = np.zeros(batch.num_rows, np.int64), [], [], []
        for i, j in hashing.slices(offsets):
            at, flat = terms(texts.slice(i, j - i))
            n[i:j] = np.bincount(at, minlength=j - i)
            if known is None:
                coded = flat.dictionary_encode()
                place, values = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            else:
                place, values = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64), known
                at, place = at[place >= 0], place[place >= 0]
            pairs, count = np.unique(place * (j - i) + at, return_counts=True)
            docs.append(pairs % max(1, j - i) + i)
            names.append(values.take(pa.array(pairs // max(1, j - i))) if known is None else pairs // max(1, j - i))
            tfs.append(count)
        doc, tf = np.concatenate(docs), np.concatenate(tfs)
        if known is None:
            coded = pa.chunked_array(names, pa.large_string()).combine_chunks().dictionary_encode()
            place, values = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        else:
            place, values = np.concatenate(names), known
        order = np.lexsort((doc, place))
        place, doc, tf = place[order], doc[order].astype(np.int32), tf[order].astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        cuts = pa.array(np.append(starts, len(place)).astype(np.int32))
        m = len(starts)
        most_tf = np.maximum.reduceat(tf, starts) if m else np.zeros(0)
        least_n = np.minimum.reduceat(n[doc], starts) if m else np.zeros(0)
        whole = pa.array([0, batch.num_rows], pa.int32())
        none = pa.nulls(m, pa.list_(pa.int64()))
        rows = {
            "span": pa.array([span] * (m + 1), pa.int64()),
            "term": pa.concat_arrays([pa.nulls(1, pa.string()), values.take(pa.array(place[starts])).cast(pa.string())]),
            "docs": pa.concat_arrays([pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(doc))]),
            "tf": pa.concat_arrays([pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tf))]),
            "most_tf": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(most_tf.astype(np.int64))]),
            "least_n": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(least_n.astype(np.int64))]),
            "n": pa.concat_arrays([pa.ListArray.from_arrays(whole, pa.array(n)), none]),
            "ids": pa.concat_arrays([pa.ListArray.from_arrays(whole, batch.column("doc_id").combine_chunks()), none]),
        }
        yield pa.record_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, RANGE_ROWS):
                yield from block(span, pa.table(batch.slice(i, RANGE_ROWS)))
                span += 1

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, flat = terms(batch.column("text"))
        keys = batch.select(["item_id", "ikey"]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*keys.columns, flat.cast(pa.string())], names=["item_id", "ikey", "term"])


def contribution(tf, m):
    """The saturated share of a term, whole numbers throughout; arrays or numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _stage(n_docs: int, n_terms: int, k: int):
    """One owner's visit: add its postings to the accumulators and drop what cannot win.

    Left is the bundle: a first row without ``rest`` holds the documents' lengths as its
    scores, the others are items; ``rest`` is the most that this and each later stage can
    add. Right are the owner's postings, with the items that take them and their gains."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        head = pc.is_null(left.column("rest"))
        lengths = left.filter(head).column("scores").combine_chunks().flatten().to_numpy()
        items = left.filter(pc.invert(head))
        m = 25 + (75 * lengths * n_docs) // n_terms
        gained: dict[tuple, list] = {}
        for docs, tf, takers in zip(right.column("docs"), right.column("tf"), right.column("takers")):
            at = docs.values.to_numpy()
            shares = contribution(tf.values.to_numpy().astype(np.int64), m[at])
            for taker in takers.as_py():
                gained.setdefault((taker["item_id"], taker["ikey"]), []).append((taker["gain"], at, shares))
        out_docs, out_scores, rests = [], [], []
        for item, ikey, docs, scores, rest in zip(*(items.column(c) for c in ("item_id", "ikey", "docs", "scores", "rest"))):
            score = np.zeros(len(lengths), np.int64)
            score[docs.values.to_numpy()] = scores.values.to_numpy()
            for gain, at, shares in gained.get((item.as_py(), ikey.as_py()), ()):
                score[at] += gain * shares  # a list holds a document once
            later = rest.as_py()[1:]
            doc = np.flatnonzero(score)
            if len(doc) > k:
                held = score[doc]
                doc = doc[held + sum(later) >= np.partition(held, len(held) - k)[len(held) - k]]
                if not later:  # of equal scores the smaller numbers, which have the smaller ids
                    doc = np.sort(doc[np.lexsort((doc, -score[doc]))[:k]])
            out_docs.append(doc.astype(np.int32))
            out_scores.append(score[doc])
            rests.append(later)
        done = items.select(["span", "bundle", "item_id", "ikey"])
        done = done.append_column("docs", pa.array(out_docs, pa.list_(pa.int32()))).append_column("scores", pa.array(out_scores, pa.list_(pa.int64())))
        done = done.append_column("rest", pa.array(rests, pa.list_(pa.int64())))
        return pa.concat_tables([left.filter(head).cast(done.schema), done])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, bundle_items: int = BUNDLE_ITEMS, term_rows: int = TERM_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    ikey = F.xxhash64("text")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().withColumn("ikey", ikey)
    per_item = asked.mapInArrow(_item_terms, "item_id long, ikey long, term string").groupBy("item_id", "ikey", "term").agg(F.count("*").alias("times"))
    per_item = cut_lineage(per_item)
    vocabulary = per_item.select("term").distinct()
    few = within(vocabulary, term_rows)
    wanted = sorted(r.term for r in vocabulary.collect()) if few else None
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = cut_lineage(narrow.mapInArrow(_postings(wanted), BLOCKS))
    totals = blocks.filter("term IS NULL").select(F.explode("n").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    spark = docs.sparkSession
    if not totals.terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_docs, n_terms = totals.docs, totals.terms

    postings = blocks.filter("term IS NOT NULL").select("span", "term", "docs", "tf", "most_tf", "least_n")
    if not few:
        postings = postings.join(vocabulary, "term", "left_semi")
    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    owner = F.lit(len(OWNERS) - 1)
    for s in reversed(range(len(OWNERS) - 1)):
        owner = F.when(F.col("df") <= OWNERS[s] * n_docs, s).otherwise(owner)
    owned = df.select("term", weight.alias("w"), owner.alias("stage"))
    bundles = max(1, -(-asked.count() // bundle_items))
    bundle = F.pmod(F.xxhash64("item_id", "ikey"), F.lit(bundles)).cast("int")
    taker = F.struct("item_id", "ikey", (F.col("w") * F.col("times")).alias("gain"))
    takers = per_item.join(owned, "term").groupBy("term", "stage", bundle.alias("bundle")).agg(F.collect_list(taker).alias("takers"))
    takers = cut_lineage(takers)

    # what a list can add at most: contributions rise with tf and fall with length
    shortest = 25 + F.expr(f"(75 * least_n * {n_docs}L) div {n_terms}L")
    most = F.expr("1000000000L * most_tf") / (1000 * F.col("most_tf") + 8 * shortest)
    offered = postings.withColumn("most", F.floor(most) + 1).join(bounded(takers, term_rows), "term")
    stages = range(len(OWNERS))
    rest = [F.sum(F.when(F.col("stage") == s, F.col("taker.gain") * F.col("most")).otherwise(0)) for s in stages]
    start = offered.select("span", "bundle", "stage", "most", F.explode("takers").alias("taker")).groupBy("span", "bundle", "taker.item_id", "taker.ikey").agg(F.array(*rest).alias("rest"))
    start = cut_lineage(start)
    none = [F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores")]
    lengths = blocks.filter("term IS NULL").select("span", F.col("n").alias("scores"))
    heads = start.select("span", "bundle").distinct().join(lengths, "span")
    heads = heads.select("span", "bundle", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("ikey"), none[0], "scores", F.lit(None).cast("array<long>").alias("rest"))
    carried = heads.unionByName(start.select("span", "bundle", "item_id", "ikey", *none, "rest"))
    for s in stages:
        own = offered.filter(F.col("stage") == s).select("span", "bundle", "docs", "tf", "takers")
        carried = carried.groupBy("span", "bundle").cogroup(own.groupBy("span", "bundle")).applyInArrow(_stage(n_docs, n_terms, k), BUNDLES)

    ids = blocks.filter("term IS NULL").select("span", "ids")
    hits = carried.filter("rest IS NOT NULL").select("span", "item_id", "ikey", F.explode(F.arrays_zip("docs", "scores")).alias("hit"))
    hits = hits.join(ids, "span").select("item_id", "ikey", F.get("ids", F.col("hit.docs")).alias("doc_id"), F.col("hit.scores").alias("score"), "span", F.col("hit.docs").alias("at"))
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("span"), F.col("at")]
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "ikey").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score")
