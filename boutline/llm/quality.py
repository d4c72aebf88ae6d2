"""Line-first cleaning: rules judge lines, failing lines go, and a document that
loses too much of its text, or fails the document rules, goes as a whole.

Row-local DataFrame expressions: no shuffle, no Python on the executors.

Defined cases: a null or empty text has no words and is rejected (fewer than
``min_words``); repeated rows are judged each by themselves; an empty table gives no
rows; extra columns are ignored by :func:`judge` and kept by :func:`clean`, also when
they bear the names of measures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutline.llm.common import WORD, grams, let, words

SYMBOLS = "[#*$%&|<>]"

# Phrases of page furniture, tested on lines of at most ``max_furniture_words``.
NAVIGATION = r"(?i)^\W*(?:home|menu|next|previous|back to top|skip to (?:main )?content|read more|click here|share this|log ?in|sign ?(?:in|up)|search|contact us|about us|site ?map)\b"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies",
    "accept all cookies", "enable javascript", "javascript is disabled", "javascript is required", "subscribe to our newsletter", "powered by",
)
# Three or more separators between short labels: a menu or breadcrumb.
MENU = r"(?:\s[|»·]\s[^|»·]{1,40}){3,}"
# What a line must hold to be odd or a menu.
MARKS = "[#*$%&|<>»·]"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the document and line rules.

    min_words, max_repeat_pct: document rules on the input.
    max_symbol_pct: a line fails if such a share of its characters is neither letter,
    digit, space nor ordinary punctuation.
    max_furniture_words: navigation and boilerplate phrases count in lines up to this length.
    max_lost_pct: a document is rejected if failing lines hold more of its words.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    repeat_window: int = 8
    max_symbol_pct: int = 10
    max_furniture_words: int = 15
    max_lost_pct: int = 50


def repeat_words(tokens: Column, n: int) -> Column:
    """How many words lie in an n-word window that the text holds twice or more.

    Windows are hashed to 64 bits; sorted with their places, equal neighbours are the
    repeated ones. Their places, sorted, are then merged into covered stretches. A text
    whose windows are all distinct is done after the distinct count.
    """
    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(n)), F.lit(n)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    def places(keyed: Column) -> Column:
        after = F.slice(keyed, 2, F.greatest(F.size(keyed) - 1, F.lit(0)))
        pairs = F.zip_with(keyed, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def count(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(keyed, places), covered)).otherwise(F.lit(0).cast("long"))

    return let(tokens, lambda t: let(grams(t, n), count))


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether a line is broken punctuation, navigation or boilerplate. Lines without
    a word never fail; they have nothing to lose. Cheap tests stand before dear ones."""
    odd = 100 * F.regexp_count(line, F.lit(SYMBOLS)) > rules.max_symbol_pct * F.length(line)
    short = (F.length(line) <= 16 * rules.max_furniture_words) & (F.regexp_count(line, F.lit(WORD)) <= rules.max_furniture_words)
    furniture = short & (line.rlike(NAVIGATION) | let(F.lower(line), lambda low: reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE))))
    marked = line.rlike(MARKS) & (odd | line.rlike(MENU))
    return marked | furniture | (~line.rlike(r"[\p{L}\p{N}]") & line.rlike(WORD))


def measured(text: Column, rules: Rules) -> Column:
    """A struct of all measures of a text."""
    text = F.coalesce(text, F.lit(""))
    worded = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))

    def of(tokens: Column) -> Column:
        n = F.size(tokens).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(tokens, rules.repeat_window).alias("n_repeat_words"),
            F.aggregate(F.filter(worded, lambda line: line_fails(line, rules)), F.lit(0).cast("long"), lambda total, line: total + F.regexp_count(line, F.lit(WORD))).alias("n_lost_words"),
        )

    return let(words(text), of)


def verdict(m: Column, rules: Rules) -> tuple[Column, Column]:
    """(fails the document rules, is kept) from the struct of measures."""
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_pct * m["n_words"])
    return failed, ~failed & (100 * m["n_lost_words"] <= rules.max_lost_pct * m["n_words"])


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a document: its measures, ``base_failed`` and ``kept``."""
    m = docs.select("doc_id", measured(F.col("text"), rules).alias("m"))
    failed, kept = verdict(F.col("m"), rules)
    return m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "m.n_lost_words")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents kept, all columns as they were but for ``text``, which has lost its
    failing lines, and ``n_chars``, where there is one, which is the new length."""
    m = measured(F.col("text"), rules)
    _, kept = verdict(m, rules)
    text = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda line: ~line_fails(line, rules)), "\n")
    keep = docs.filter(let(m, lambda x: verdict(x, rules)[1]))
    keep = keep.withColumn("text", text)
    if "n_chars" in docs.columns:
        keep = keep.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType if not isinstance(docs.schema["n_chars"].dataType, T.NullType) else "long"))
    return keep.select(docs.columns)
