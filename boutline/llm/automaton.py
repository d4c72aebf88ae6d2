"""Language-model scores by a weighted backoff automaton.

States are the words seen in training, a start state and the empty state. A state has an
arc for every word seen after its word, with the smoothed log-probability, and a failure
arc to the empty state with the weight that is left; the empty state has an arc for every
word and one for unknown ones. Bigrams are smoothed after Witten and Bell:

    P(w | u) = (c(u, w) + T(u) P(w)) / (c(u) + T(u)),  P(w) = (c(w) + 1) / (N + V + 1)

with T(u) the number of distinct words seen after u, so an unseen pair takes the failure
arc T(u) / (c(u) + T(u)) and then the arc of P(w). Both are distributions over the V words
and one unknown class. A text's last token is its end, the same word in all texts.

The automaton of a large corpus fits no machine, so each block of documents gets the part
that its texts can reach. Blocks send their distinct words and pairs with training counts
to segments of the hash space; segments add the counts up and answer each block, and name
one block the owner of a pair, so that T(u) is added up from blocks that each know a
part. A second round of messages carries T. The text of a block is then traversed once
from left to right. Messages are packed arrays, one for a block and segment; counts cover
the whole corpus, with no cut by size.

Defined cases: a null or blank text has one token, its end; without any training text N
and V are 0 and every token is unknown; rows that share a doc_id are scored each by
itself; a null doc_id is held out or not by the checksum of an empty string; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm import hashing
from boutline.llm.substrings import BLOCK_BYTES
from boutline.session import cut_lineage

END = np.uint64(0xE5D1A9C4B7F03C21)
START = np.uint64(0x51A7B3C9D2E4F685)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in the smallest width that holds them; the first byte names it."""
    top = int(counts.max()) if len(counts) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[packed[0]], offset=1).astype(np.int64)


class Tokens:
    """Token hashes of a block's texts, each text closed by the end, with the hash of the
    pair that each token makes with the one before, and whether its text is for training."""

    def __init__(self, docs: pa.Table) -> None:
        parts, counts = [], []
        for w in hashing.words(docs.column("text"), lower=True):
            n = w.counts + 1
            at = np.cumsum(n) - 1
            tokens = np.full(int(n.sum()), END)
            inner = np.ones(len(tokens), bool)
            inner[at] = False
            tokens[inner] = w.hashes
            parts.append(tokens)
            counts.append(n)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.before = np.concatenate([[START], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.before[self.starts] = START
        self.pairs = hashing.mixed(self.before * _PAIR ^ self.tokens)
        self.train = np.repeat(~docs.column("held_out").to_numpy(zero_copy_only=False), self.counts)

    def counted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, their training counts, and where each key is among them."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(inverse[self.train], minlength=len(distinct)), inverse


def by_segment(keys: np.ndarray, segments: int) -> list[slice]:
    """Sorted keys fall into segments by range, so a segment's are a slice."""
    step = (1 << 64) // segments + 1
    cuts = np.searchsorted(keys, np.array([min(i * step, (1 << 64) - 1) for i in range(segments)], np.uint64))
    ends = np.append(cuts[1:], len(keys))
    return [slice(int(a), int(b)) for a, b in zip(cuts, ends, strict=True)]


COUNTS = "segment long, block long, words binary, word_counts binary, pairs binary, pair_counts binary"
TOTALS = "block long, segment long, word_totals binary, pair_totals binary, owned binary, n long, v long"
FOLLOWERS = "segment long, block long, words binary, followers binary"
FOLLOWED = "block long, segment long, followers binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _count(segments: int):
    def run(docs: pa.Table) -> pa.Table:
        block, t = docs.column("block")[0].as_py(), Tokens(docs)
        words, word_counts, _ = t.counted(t.tokens)
        pairs, pair_counts, _ = t.counted(t.pairs)
        rows = []
        for s, (a, b) in enumerate(zip(by_segment(words, segments), by_segment(pairs, segments), strict=True)):
            # every segment answers every block, so that all get the corpus totals
            rows.append((s, block, words[a].tobytes(), packed_counts(word_counts[a]), pairs[b].tobytes(), packed_counts(pair_counts[b])))
        return _table(COUNTS, rows)

    return run


def _gather(table: pa.Table, keys: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all blocks, sums of their values, and each block's places in them."""
    own = [np.frombuffer(x, np.uint64) for x in table.column(keys).to_pylist()]
    distinct, inverse = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.concatenate([unpacked(x) for x in table.column(values).to_pylist()])
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, inverse, counts)
    places = np.split(inverse, np.cumsum([len(x) for x in own])[:-1])
    return distinct, totals, counts, places


def _add_up(table: pa.Table) -> pa.Table:
    segment, blocks = table.column("segment")[0].as_py(), table.column("block").to_pylist()
    _, word_totals, _, word_at = _gather(table, "words", "word_counts")
    _, pair_totals, pair_counts, pair_at = _gather(table, "pairs", "pair_counts")
    n, v = int(word_totals.sum()), int(np.count_nonzero(word_totals))
    taken = pair_totals == 0
    rows = []
    for i in np.argsort(blocks):
        owned = ~taken[pair_at[i]]
        taken[pair_at[i]] = True
        rows.append((blocks[i], segment, packed_counts(word_totals[word_at[i]]), packed_counts(pair_totals[pair_at[i]]), np.packbits(owned).tobytes(), n, v))
    return _table(TOTALS, rows)


def _in_order(answers: pa.Table) -> pa.Table:
    return answers.sort_by("segment")


def _joined(answers: pa.Table, name: str) -> np.ndarray:
    parts = [unpacked(x) for x in answers.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _own_followers(segments: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(FOLLOWERS, [])
        block, t, answers = docs.column("block")[0].as_py(), Tokens(docs), _in_order(answers)
        pairs, first = np.unique(t.pairs, return_index=True)
        cuts = by_segment(pairs, segments)
        owned = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c.stop - c.start) for x, c in zip(answers.column("owned").to_pylist(), cuts, strict=True)])
        words, inverse = np.unique(t.before, return_inverse=True)
        followers = np.bincount(inverse[first], weights=owned, minlength=len(words)).astype(np.int64)
        rows = [(s, block, words[c].tobytes(), packed_counts(followers[c])) for s, c in enumerate(by_segment(words, segments)) if c.stop > c.start]
        return _table(FOLLOWERS, rows)

    return run


def _add_followers(table: pa.Table) -> pa.Table:
    segment, blocks = table.column("segment")[0].as_py(), table.column("block").to_pylist()
    _, totals, _, at = _gather(table, "words", "followers")
    return _table(FOLLOWED, [(b, segment, packed_counts(totals[at[i]])) for i, b in enumerate(blocks)])


def _traverse(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of a block's texts. Which state a token leaves the automaton in depends on
    the token alone, so one pass of array operations is the traversal of all texts."""
    if not docs.num_rows:
        return _table(SCORES, [])
    t = Tokens(docs)
    both = answers.sort_by([("kind", "ascending"), ("segment", "ascending")])
    totals, followed = both.filter(pc.equal(both.column("kind"), 0)), both.filter(pc.equal(both.column("kind"), 1))
    n, v = (int(np.sum(totals.column(c).to_numpy())) for c in ("n", "v"))
    words, _, at = t.counted(t.tokens)
    pairs, _, pair_at = t.counted(t.pairs)
    states, state_at = np.unique(t.before, return_inverse=True)
    word_count, pair_count, followers = _joined(totals, "words"), _joined(totals, "pairs"), _joined(followed, "words")

    # arcs of the empty state; arcs and failure arcs of the others
    empty = np.log10((word_count + 1) / (n + v + 1))
    known = np.minimum(np.searchsorted(words, states), len(words) - 1)
    visits = np.where(words[known] == states, word_count[known], 0)
    visits[states == START] = word_count[words == END][0] if (words == END).any() else 0
    mass = np.maximum(visits + followers, 1)
    failure = np.where(visits > 0, np.log10(np.maximum(followers, 1) / mass), 0.0)
    first = np.zeros(len(pairs), np.int64)
    first[pair_at] = np.arange(len(pair_at))
    s, w = state_at[first], at[first]
    arc = np.log10((pair_count + followers[s] * (word_count[w] + 1) / (n + v + 1)) / mass[s], where=pair_count > 0, out=np.zeros(len(pairs)))

    step = np.where(pair_count[pair_at] > 0, arc[pair_at], failure[state_at] + empty[at])
    base = np.log10((word_count + 1) / (n + v + 1))[at]
    starts = t.starts
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(t.counts),
            "n_known": pa.array(np.add.reduceat((word_count[at] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(docs.num_rows, n)),
            "base_score": pa.array(np.add.reduceat(base, starts)),
            "score": pa.array(np.add.reduceat(step, starts)),
        }
    )


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """``docs`` (doc_id, text) scored by a model of the rows where ``held_out`` is false."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("long").alias("block"))
    by_block = rows.groupBy("block")
    totals = cut_lineage(by_block.applyInArrow(_count(blocks), COUNTS).groupBy("segment").applyInArrow(_add_up, TOTALS))
    followers = by_block.cogroup(totals.groupBy("block")).applyInArrow(_own_followers(blocks), FOLLOWERS)
    followed = followers.groupBy("segment").applyInArrow(_add_followers, FOLLOWED)
    none = F.lit(None).cast("binary")
    answers = totals.select("block", "segment", F.lit(0).alias("kind"), F.col("word_totals").alias("words"), F.col("pair_totals").alias("pairs"), "n", "v").unionByName(
        followed.select("block", "segment", F.lit(1).alias("kind"), F.col("followers").alias("words"), none.alias("pairs"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("v"))
    )
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_traverse, SCORES)
