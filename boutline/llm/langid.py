"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader, then calibrated by a temperature.

Features are n-grams of one to three lower-cased characters (letters as they are, every
other character as one mark, runs of marks as one), hashed to ``DIMENSION`` buckets; a
text's value is its share of all its n-grams times the inverse document frequency. Whole
texts count, in training, in the frequencies and in the predictions.

Document frequencies cover all learning rows. Weights are fitted on at most ``FIT_ROWS``
of them and the temperature on at most ``TEMPERATURE_ROWS`` others, each those with the
smallest hash of id and text: bounded samples, in one task. The per-coordinate FTRL update
with L1 keeps weights that never pay at zero, L2 keeps the others small.

Defined cases: null texts and texts without a letter are ``und`` with score 0; learning
rows without a language or a letter are passed over; with no learning rows at all every
text is ``und``; ties go to the language first by code point; repeated rows count each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.session import cut_lineage

DIMENSION = 1 << 16
ORDERS = (1, 2, 3)
FIT_ROWS = 6_000
TEMPERATURE_ROWS = 2_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
EPOCHS = 5
# Shares are small numbers; in per mille-like units the penalties and rates fit them.
SCALE = 30.0
SLICE_CHARS = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Of each code point the lower-case letter, or 0 where it is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each text closed by a mark, and their offsets."""
    raw = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    codes = _letter_table()[raw]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, index of its text) for slices of the texts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
            size += len(texts[j])
            j += 1
        codes, offsets = _codes(texts[i:j])
        owner = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(offsets))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        codes, owner = codes[keep], owner[keep]
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = codes[: len(codes) - n + 1].astype(np.uint32)
            for k in range(1, n):
                h = h * np.uint32(0x85EBCA6B) ^ codes[k : len(codes) - n + 1 + k]
            h = (h ^ np.uint32(n * 0x9E3779B9 % (1 << 32))) * np.uint32(0xC2B2AE35)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
            inside = owner[: len(h)] == owner[n - 1 :]
            yield (h >> np.uint32(16))[inside], owner[: len(h)][inside]
        i = j


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its n-grams in each."""
    ids = np.concatenate([b for b, _ in ngrams([text])] or [np.zeros(0, np.uint32)])
    counts = np.bincount(ids, minlength=DIMENSION)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, len(ids))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition, one row with the number of texts."""
    total, n, mark = np.zeros(DIMENSION, np.int64), 0, np.zeros(DIMENSION, bool)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for ids, _ in ngrams([text]):
                mark[ids] = True
            total += mark
            mark[:] = False
            n += 1
    if n:
        part = np.arange(DIMENSION // 4096)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(total.reshape(-1, 4096)), pa.list_(pa.int64())), pa.array(np.full(len(part), n))], ["part", "df", "n"])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Over all ``rows`` (text); partial vectors are added up by Spark, and the sum, of a
    fixed size, comes to the driver."""
    parts = rows.select("text").mapInArrow(_frequencies, "part long, df array<long>, n long")
    summed = parts.select("part", F.posexplode("df").alias("at", "df"), "n").filter("df > 0 or at = 0").groupBy("part", "at").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMENSION, np.int64), 0
    for r in summed:
        df[r["part"] * 4096 + r["at"]] = r["df"]
        n = max(n, r["n"])
    return df, n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and biases. FTRL-proximal, one row at a time."""
    z, n = np.zeros((DIMENSION + 1, n_classes)), np.zeros((DIMENSION + 1, n_classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, DIMENSION), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            square = g * g
            sigma = (np.sqrt(ns + square) - np.sqrt(ns)) / ALPHA
            z[at], n[at] = zs + g - sigma * w, ns + square
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log-loss, by ternary search on its logarithm."""
    lo, hi = -4.0, 4.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).sum())

    for _ in range(60):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fit(languages: list[str], idf: np.ndarray):
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("draw")
        rows = [(at, x * idf[at]) for at, x in map(_sparse, sample.column("text").to_pylist())]
        labels = np.array([languages.index(x) for x in sample.column("lang").to_pylist()])
        for_fit = sample.column("for_fit").to_numpy(zero_copy_only=False)
        fit, rest = np.flatnonzero(for_fit), np.flatnonzero(~for_fit)
        w, bias = ftrl([rows[i] for i in fit], labels[fit], len(languages))
        t = temperature(np.stack([rows[i][1] @ w[rows[i][0]] + bias for i in rest]), labels[rest]) if len(rest) else 1.0
        return pa.table({"weights": pa.array([w.astype(np.float64).tobytes()]), "bias": pa.array([bias.tobytes()]), "temperature": pa.array([t])})

    return run


def _predict(languages: list[str], table: np.ndarray, bias: np.ndarray, t: float):
    """``table``: IDF times weight of every bucket, so a score is a mean over n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sums, total = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
            for ids, owner in ngrams(texts):
                if len(ids):
                    first, last = int(owner[0]), int(owner[-1])
                    total[first : last + 1] += np.bincount(owner - first, minlength=last - first + 1)
                    for k in range(len(languages)):
                        sums[first : last + 1, k] += np.bincount(owner - first, weights=table[k][ids], minlength=last - first + 1)
            p = _softmax((sums / np.maximum(total, 1)[:, None] + bias) / t)
            best = p.argmax(axis=1)
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            names = [languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
            scores = np.where(lettered, p[np.arange(len(texts)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang),
    learned from the rows where ``held_out`` is false."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    learn = rows.filter("not held_out and lang is not null and lettered")
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    languages = sorted(r["lang"] for r in learn.select("lang").distinct().collect())
    if not languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    df, n = document_frequencies(learn)
    idf = SCALE * (np.log((1 + n) / (1 + df)) + 1)
    drawn = learn.select("text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    cut = drawn.select("draw").orderBy("draw").limit(FIT_ROWS + TEMPERATURE_ROWS).agg(F.max("draw")).first()[0]
    sample = cut_lineage(drawn.filter(F.col("draw") <= cut).withColumn("for_fit", F.pmod(F.xxhash64("draw"), F.lit(4)) != 0).withColumn("one", F.lit(1)))
    model = sample.groupBy("one").applyInArrow(_fit(languages, idf), "weights binary, bias binary, temperature double").first()
    weights = np.frombuffer(model["weights"]).reshape(DIMENSION, len(languages))
    table = np.ascontiguousarray((weights * idf[:, None]).T)
    spread = rows.select("doc_id", "held_out", "text", "lettered")
    return spread.mapInArrow(_predict(languages, table, np.frombuffer(model["bias"]), model["temperature"]), schema)
