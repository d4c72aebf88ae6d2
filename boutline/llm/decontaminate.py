"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question keeps its template when
its values are changed. Five-token windows of the templates are hash-joined; the names
that fill the slots of an aligned occurrence must then map one to one from the benchmark
item to the document, and so must half of its numbers and units unless the whole item is
there (small numbers are often equal, or become equal, by chance); and an item is found where consistent windows cover half of its
windows. Besides, windows of the words as they are (``exact_tokens``) are searched in the
same way, without slots, so that a verbatim copy of any item is found. The cover is counted
for each variant of an item by itself. DataFrame functions only; texts are not shuffled, only windows that match are.

Defined cases: null or empty texts, on either side, match nothing; an item of fewer
than five words is searched whole, one of a single word as a line of its own (inside
lines it would be in every text with that word), one without letters and digits not at all; items of equal text count as the one with the smallest
item_id; a template window with fewer than three tokens besides placeholders is not searched
(it would fit anything); repeated rows and rows sharing a doc_id are judged by id and text; a
null doc_id is carried; empty tables give no matches; extra columns are ignored by
:func:`matches` and kept by :func:`without_leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import SPACES, let
from boutline.plans.bounded import bounded
from boutline.session import cut_lineage

WINDOW = 5
MIN_LITERAL = 3
MIN_COVER_PCT = 50
MIN_AGREE_PCT = 50

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
PLACEHOLDER = f"[{NUMBER}{NAME}{UNIT}]"
# The first code point of these scripts: texts below it need no look at scripts.
MAY_BE_UNSPACED = r"[\u0E00-\x{10FFFF}]"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
TEMPLATE, PLAIN, EXACT = 0, 1, 2
# Units that may follow a number.
UNITS = (
    "km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|h|hr|hrs|hours?|min|mins|minutes?|s|sec|secs|seconds?|days?|weeks?|months?|years?|miles?|met(?:er|re)s?|"
    "kilomet(?:er|re)s?|feet|foot|ft|inch(?:es)?|yards?|pounds?|ounces?|grams?|kilograms?|lit(?:er|re)s?|dollars?|euros?|cents?|percent|degrees?|mph|kph"
)


def _stripped(text: Column) -> Column:
    """Letters, digits, placeholders and spaces only; the words that are left keep their
    order, so the n-th token of a template is the n-th of the raw text."""
    return F.regexp_replace(text, f"[^a-zA-Z0-9\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D{NUMBER}{NAME}{UNIT}]+", "")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def raw_tokens(text: Column) -> Column:
    return _tokens(_stripped(F.coalesce(text, F.lit(""))))


def exact_tokens(text: Column) -> Column:
    """Words in lower case, nothing replaced; in scripts without spaces, characters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(t.rlike(UNSPACED), F.regexp_replace(t, f"({UNSPACED})", " $1 ")).otherwise(t)
    t = F.when(t.rlike(MAY_BE_UNSPACED), spaced).otherwise(t)
    return F.array_remove(F.split(t, "[^a-z0-9\\p{L}\\p{N}\\p{M}]+"), "")


def window_hashes(tokens: Column, n: int = WINDOW) -> Column:
    """64-bit hashes of the ``n`` tokens from each place on: one pass, no arrays between."""
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))


def lone_words(text: Column) -> Column:
    """Hashes of the lines that are one word."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), exact_tokens)
    return F.array_distinct(F.transform(F.filter(lines, lambda t: F.size(t) == 1), lambda t: F.xxhash64(F.get(t, F.lit(0)))))


def template_tokens(text: Column, names: bool = True) -> Column:
    """Tokens with placeholders. A name is a capitalised word after a word and a space
    (not one that begins a sentence or line); a unit follows or clings to a number.
    Where a text has lost its case, no name can be told: items are also searched with
    their names as words (``names`` false)."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "[0-9][0-9.,:/]*", NUMBER)
    t = F.regexp_replace(t, f"{NUMBER}( ?)(?i:{UNITS})(?!\\p{{L}})", f"{NUMBER}$1{UNIT}")
    t = F.regexp_replace(t, f"[$€£¥]{NUMBER}|{NUMBER}%", UNIT + NUMBER)
    if names:
        t = F.regexp_replace(t, f"\\p{{Lu}}(?<=[\\p{{L}}{NUMBER},;] .)\\p{{Ll}}[\\p{{L}}'’-]*", NAME)
    return _tokens(F.lower(_stripped(t)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a 128-bit key of both, which holds for null ids too."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2"))


def _slots(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, type and value) of every token with a placeholder."""
    pairs = F.arrays_zip(df["template"].alias("t"), df["raw"].alias("r"))
    at = df.select(*keys, F.posexplode(pairs).alias("place", "x")).filter(F.col("x.t").rlike(PLACEHOLDER))
    return at.select(*keys, "place", F.concat(F.regexp_replace("x.t", f"[^{NUMBER}{NAME}{UNIT}]", ""), F.lower("x.r")).alias("value"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_windows, n_matched, n_slots, n_changed), a row for every
    item that a document contains, besides the key of the document."""
    items = benchmark.filter("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.min("item_id").alias("item_id"))
    text = F.col("text")
    items = cut_lineage(items.select("item_id", template_tokens(text).alias("template"), template_tokens(text, False).alias("plain"), raw_tokens(text).alias("raw"), exact_tokens(text).alias("exact")))
    variants = items.select("item_id", F.lit(TEMPLATE).alias("variant"), "template").unionByName(items.filter("plain <> template").select("item_id", F.lit(PLAIN).alias("variant"), F.col("plain").alias("template")))
    literal = F.transform("template", lambda t: F.when(t.rlike(PLACEHOLDER), 0).otherwise(1))
    each = variants.withColumn("literal", literal).select("item_id", "variant", "literal", F.posexplode(let(F.col("template"), lambda t: window_hashes(t))).alias("q", "window"))
    told = F.aggregate(F.slice("literal", F.col("q") + 1, WINDOW), F.lit(0), lambda a, b: a + b) >= MIN_LITERAL
    # whole items where they are shorter than a window
    n_words = F.size("exact")
    short = sorted(r["n"] for r in items.filter((n_words > 0) & (n_words < WINDOW)).select(n_words.alias("n")).distinct().collect())
    whole = F.lit(None).cast("array<bigint>")
    for n in short:
        whole = F.when(n_words == n, window_hashes(F.col("exact"), n)).otherwise(whole)
    exact = items.select("item_id", F.lit(EXACT).alias("variant"), F.posexplode(F.when(n_words >= WINDOW, let(F.col("exact"), lambda t: window_hashes(t))).otherwise(whole)).alias("q", "window"))
    wanted = cut_lineage(each.filter(told).select("item_id", "variant", "q", "window").unionByName(exact))
    sizes = cut_lineage(wanted.groupBy("item_id", "variant").agg(F.countDistinct("q").alias("n_item_windows")))

    keyed = _keyed(docs)
    doc, pair = ["k1", "k2"], ["k1", "k2", "item_id"]
    each = keyed.select("doc_id", *doc, F.posexplode(let(template_tokens(text), lambda t: window_hashes(t))).alias("p", "window"))
    hits = each.join(bounded(wanted.filter(F.col("variant") != EXACT)), "window").select("doc_id", *pair, "variant", "q", (F.col("p") - F.col("q")).alias("diagonal"))
    stretches = let(exact_tokens(text), lambda t: F.concat(window_hashes(t), *(F.array_distinct(window_hashes(t, n)) for n in short if n > 1)))
    if 1 in short:
        stretches = F.concat(stretches, lone_words(text))
    same = keyed.select("doc_id", *doc, F.explode(stretches).alias("window")).join(bounded(wanted.filter(F.col("variant") == EXACT)), "window")
    hits = hits.unionByName(same.select("doc_id", *pair, "variant", "q", F.lit(None).cast("int").alias("diagonal")))
    hits = cut_lineage(hits.distinct())

    def covered(windows: DataFrame) -> DataFrame:
        """Of the variants that are covered well enough, the one covered best."""
        distinct = windows.select(*pair, "doc_id", "variant", "q").distinct().groupBy(*pair, "doc_id", "variant").agg(F.count("*").alias("n_matched"))
        enough = distinct.join(bounded(sizes), ["item_id", "variant"]).filter(100 * F.col("n_matched") >= MIN_COVER_PCT * F.col("n_item_windows"))
        best = F.max(F.struct((F.col("n_matched") / F.col("n_item_windows")).alias("share"), (-F.col("variant")).alias("first"), "n_item_windows", "n_matched")).alias("best")
        return enough.groupBy(*pair, "doc_id").agg(best).select(*pair, "doc_id", "best.n_item_windows", "best.n_matched")

    likely = cut_lineage(covered(hits))
    hits = hits.join(bounded(likely.select(*pair)), pair, "left_semi")

    # what fills the slots of an occurrence, on both sides
    own = _slots(items, "item_id")
    places = hits.filter("diagonal is not null").select(*pair, "diagonal", F.explode(F.sequence(F.col("q"), F.col("q") + WINDOW - 1)).alias("place")).distinct()
    asked = places.join(own, ["item_id", "place"]).withColumn("at", F.col("place") + F.col("diagonal"))
    found = keyed.join(bounded(likely.select(*doc).distinct()), doc, "left_semi").select(*doc, template_tokens(text).alias("template"), raw_tokens(text).alias("raw"))
    theirs = _slots(found.dropDuplicates(doc), *doc).select(*doc, F.col("place").alias("at"), F.col("value").alias("filled"))
    filled = asked.join(theirs, [*doc, "at"])
    place = [*pair, "diagonal"]
    pairs = filled.groupBy(*place, "value", "filled").agg(F.count("*").alias("n")).withColumn("name", F.contains(F.col("value"), F.lit(NAME)))
    by_item = pairs.groupBy(*place, "value", "name").agg(F.count("*").alias("kinds"), F.max("n").alias("top"), F.sum("n").alias("n"), F.max(F.when(F.col("value") != F.col("filled"), 1).otherwise(0)).alias("changed"))
    by_doc = pairs.groupBy(*place, "filled", "name").agg(F.count("*").alias("kinds"), F.max("n").alias("top"))
    most, agreed = F.max(F.when(F.col("name"), F.col("kinds"))), F.sum(F.when(~F.col("name"), F.col("top")))
    alike = by_item.groupBy(*place).agg(most.alias("most"), agreed.alias("agreed"), F.sum(F.when(~F.col("name"), F.col("n"))).alias("n_numbers"), F.count("*").alias("n_slots"), F.sum("changed").alias("n_changed"))
    alike = alike.join(by_doc.groupBy(*place).agg(most.alias("most2"), agreed.alias("agreed2")), place)
    windows = hits.filter("diagonal is not null").groupBy(*place, "variant").agg(F.countDistinct("q").alias("n")).join(bounded(sizes), ["item_id", "variant"])
    whole = windows.groupBy(*place).agg(F.max(F.col("n") == F.col("n_item_windows")).alias("whole"))
    names_torn = F.greatest("most", "most2") > 1
    numbers_torn = ~F.col("whole") & (100 * F.least("agreed", "agreed2") < MIN_AGREE_PCT * F.col("n_numbers"))
    torn = F.coalesce(names_torn, F.lit(False)) | F.coalesce(numbers_torn, F.lit(False))
    slots = cut_lineage(alike.join(whole, place).withColumn("torn", torn))
    hits = hits.join(bounded(slots.filter("torn").select(*place)), place, "left_anti")
    filling = slots.filter("not torn").groupBy(*pair).agg(F.max("n_slots").alias("n_slots"), F.min("n_changed").alias("n_changed"))
    out = covered(hits).join(filling, pair, "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "item_id", "n_item_windows", "n_matched", F.coalesce("n_slots", zero).alias("n_slots"), F.coalesce("n_changed", zero).alias("n_changed"), *doc)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without those that contain a benchmark item."""
    gone = cut_lineage(matches(docs, benchmark).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct())
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    same = (F.xxhash64(doc_id, text) == F.col("_k1")) & (F.xxhash64(text, F.lit(1), doc_id) == F.col("_k2"))
    return docs.join(bounded(gone), same, "left_anti")
