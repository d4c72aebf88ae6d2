"""Mixing sources to target weights by a low-discrepancy schedule.

Van der Corput points, mapped through the cumulated targets, name the source of each
slot of the mix; slots are ranked within their source; and the r-th slot of a source
takes the r-th block of equally many words of that source's documents in shuffled
order, which begins anew when it is used up. The mix is read in the order of slots: every
document tells which slots hold words of it, so after any number of slots each source
has had its share to within a few slots.

Orders and ranks are two-level: rows are ranked inside parts of bounded share (4096
ranges of a hash, 4,096 slots) and the totals of parts are cumulated, so a source with
a third of all rows is spread over as many tasks as its parts.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; documents repeated row by row are told apart by their
place; a null doc_id is carried along; an empty table gives no rows; extra columns are
carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boutline.llm.common import WORD
from boutline.session import cut_lineage

BUCKETS = 4096
CHUNK = 1 << 12
GRID = 1 << 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """``sizes`` (_key, _source, _source_size), one row a source, with _target added.

    Sources by code point, null last, weigh 1 to ``cycle``, repeating. They share all
    words by weight, none above ``max_epochs`` times its size. In the order of cap /
    weight, sources are at their cap as long as the level that the rest would get is
    above it; the first level that is not is the level of all that follow.
    """
    by_name = W.orderBy(F.col("_source").asc_nulls_last())
    by_ratio = W.orderBy("_ratio", "_rank")
    everything = W.partitionBy()
    s = sizes.withColumn("_rank", F.row_number().over(by_name))
    s = s.withColumn("_weight", ((F.col("_rank") - 1) % cycle + 1).cast("double")).withColumn("_cap", (F.col("_source_size") * max_epochs).cast("double"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    s = s.withColumn("_total", F.sum("_source_size").over(everything).cast("double")).withColumn("_capped", F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_cap"))
    s = s.withColumn("_left", F.sum("_weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
    s = s.withColumn("_open", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(everything))
    below = F.col("_open").isNull() | (F.struct("_ratio", "_rank") < F.struct("_open._ratio", "_open._rank"))
    return s.withColumn("_target", F.when(below, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_open._level")))).select("_key", "_source", "_source_size", "_target")


def schedule(spark: SparkSession, shares: DataFrame, slots: int) -> DataFrame:
    """Slots (_slot, _key, _block): ``shares`` has (_key, _target, _slots), _slots being
    how many slots a source gets, ``slots`` in all.

    The point of slot k is k with its bits reversed, as a fraction. Where a source has
    its full number of slots, later ones stay void; where the points leave it short (by a
    few slots at most, as the sequence is evenly spread), its last slots follow at the end.
    """
    up_to = W.orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = shares.withColumn("_all", F.sum("_target").over(W.partitionBy())).withColumn("_to", F.sum("_target").over(up_to))
    s = s.filter("_target > 0").select("_key", "_slots", ((F.col("_to") - F.col("_target")) / F.col("_all")).alias("_lo"), (F.col("_to") / F.col("_all")).alias("_hi"))
    cells = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * GRID), F.least(F.floor(F.col("_hi") * GRID), F.lit(GRID).cast("long")))))
    point = F.conv(F.reverse(F.lpad(F.bin("_slot"), 52, "0")), 2, 10).cast("double") / float(1 << 52)
    k = spark.range(slots).withColumnRenamed("id", "_slot").withColumn("_point", point).withColumn("_cell", F.floor(F.col("_point") * GRID))
    named = k.join(cells, "_cell").filter("_point >= _lo and _point < _hi").select("_slot", "_key", "_slots", F.floor(F.col("_slot") / CHUNK).alias("_chunk"))
    per_chunk = named.groupBy("_key", "_chunk").agg(F.count("*").alias("_n"))
    before = per_chunk.withColumn("_before", F.sum("_n").over(W.partitionBy("_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).drop("_n")
    inside = F.row_number().over(W.partitionBy("_key", "_chunk").orderBy("_slot")) - 1
    ranked = named.withColumn("_in", inside).join(before, ["_key", "_chunk"]).select("_slot", "_key", "_slots", (F.col("_before") + F.col("_in")).alias("_block"))
    got = per_chunk.groupBy("_key").agg(F.sum("_n").alias("_got"))
    short = s.join(got, "_key", "left").fillna(0, ["_got"]).filter("_got < _slots")
    closing = short.withColumn("_block", F.explode(F.sequence(F.col("_got"), F.col("_slots") - 1))).select((F.lit(slots) + F.col("_block")).alias("_slot"), "_key", "_block")
    return ranked.filter("_block < _slots").select("_slot", "_key", "_block").unionByName(closing)


def mix(docs: DataFrame, size: Column | None = None, block_words: int = 1024, max_epochs: int = 3) -> DataFrame:
    """``docs`` (doc_id, source, any others) with size, source_size, target, taken,
    first_slot and slots.

    taken is the number of words of the document in the mix, repeats counted: what its
    places in the shuffled order share with the blocks that slots have taken. slots lists
    (slot, words) in order, first_slot the first of them (null without words); see
    :func:`in_order`. Columns of ``docs`` with these six names are replaced.
    """
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "first_slot", "slots")]
    rest = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    hashed = F.xxhash64("doc_id", *(["text"] if "text" in docs.columns else []))
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(*rest, F.col("source").cast("string").alias("_source"), key.alias("_key"), size.alias("_size"), hashed.alias("_hash"), F.col("doc_id").alias("_id"))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKETS.bit_length() + 1))

    if "text" not in docs.columns:
        rows = cut_lineage(rows)  # narrow, and read three times: sizes are counted once

    parts = cut_lineage(rows.groupBy("_key", "_source", "_bucket").agg(F.sum("_size").alias("_n")))
    total = parts.groupBy("_key", "_source").agg(F.sum("_n").alias("_source_size"))
    shares = targets(total, max_epochs).withColumn("_words", F.round("_target").cast("long")).withColumn("_slots", F.ceil(F.col("_words") / block_words).cast("long"))
    shares = cut_lineage(shares)
    slots = shares.agg(F.sum("_slots")).first()[0] or 0
    before = parts.withColumn("_before", F.sum("_n").over(W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
    before = before.join(shares.drop("_source"), "_key").select("_key", "_bucket", "_before", "_source_size", "_target", "_words")
    before = cut_lineage(before)  # the tables that follow are small and end a plan each, so that the driver holds no plan of the whole job

    inside = F.sum("_size").over(W.partitionBy("_key", "_bucket").orderBy("_hash", "_id", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size")
    placed = rows.withColumn("_in", inside).join(before, ["_key", "_bucket"]).withColumn("_start", F.col("_before") + F.col("_in"))

    # the places of a document in each pass over its source, cut at block borders
    narrow = placed.filter("_size > 0").select("_key", "_start", "_size", "_source_size", "_words")
    passes = narrow.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    at = passes.withColumn("_from", F.col("_pass") * F.col("_source_size") + F.col("_start")).filter("_from < _words").withColumn("_upto", F.least(F.col("_from") + F.col("_size"), F.col("_words")))
    first, last = F.floor(F.col("_from") / block_words), F.floor((F.col("_upto") - 1) / block_words)
    pieces = at.withColumn("_block", F.explode(F.sequence(first, last)))
    pieces = pieces.select("_key", "_start", "_block", (F.least("_upto", (F.col("_block") + 1) * block_words) - F.greatest("_from", F.col("_block") * block_words)).alias("_part"))
    taken = pieces.join(cut_lineage(schedule(spark, shares, slots)), ["_key", "_block"])
    held = F.array_sort(F.collect_list(F.struct(F.col("_slot").alias("slot"), F.col("_part").alias("words"))))  # as many as its words ask for
    taken = cut_lineage(taken.groupBy("_key", "_start").agg(F.sum("_part").alias("_taken"), held.alias("_held")))

    out = placed.withColumn("_place", F.when(F.col("_size") > 0, F.col("_start"))).join(taken.withColumnRenamed("_start", "_place"), ["_key", "_place"], "left")
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)]
    return out.select(*back, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"), F.get("_held", F.lit(0))["slot"].alias("first_slot"), F.col("_held").alias("slots"))


def in_order(mixed: DataFrame, *keep: str) -> DataFrame:
    """(slot, words, keep...): the mix as it is to be read, a row for each piece of a
    document, repeats as often as they are taken, ranges of slots after one another."""
    pieces = mixed.select(*keep, F.explode("slots").alias("_s")).select("_s.slot", "_s.words", *keep)
    return pieces.repartitionByRange("slot").sortWithinPartitions("slot")
