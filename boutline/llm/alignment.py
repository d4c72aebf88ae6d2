"""Alignment of two tokenizers by products of token-byte incidence matrices.

Over the bytes of a text (with one space before it) each tokenizer is a sparse 0/1 matrix
in CSR form, a row a token and a column a byte. Gustavson's row-by-row product A . B^T
holds, for each pair of tokens, the bytes that they share: the overlap links. Offsets
where both tokenizers end a token cut the text into groups; the products of the
token-group incidences link the tokens that share a group.

1. Texts are cut before a space that follows a printable ASCII character. No token of
   either vocabulary crosses such a place (:class:`Pair` checks this for the pieces; the
   byte-level pattern never joins a character and the space after it), so a block of
   texts encodes and multiplies each distinct stretch once. A third product, documents x
   stretches by stretches x linked id pairs, gives each document's links.
2. Each block reports how many of its documents hold an id pair, once a pair however many
   documents do, so the pair counts and the best of each A id need no row a document.
3. The counts of a block's own pairs come back to it and are summed by document.

Defined cases: texts that are null, empty, or not reproduced byte for byte by both
tokenizers have no tokens and zeros; every row is a document of its own, whatever its id;
an empty table gives no rows; extra columns are ignored. Blocks hold ``BLOCK_BYTES`` of
text, or one longer text.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm import hashing
from boutline.session import cut_lineage

BLOCK_BYTES = 1 << 22
#: Characters of stretches that are encoded at once.
RUN_CHARS = 1 << 16
#: Documents whose links are multiplied out at once, by stretches.
SLICE = 1 << 18
# The byte-level pre-tokenizer that SPLIT stands for, and its pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile("(?<=[!-~])(?= )")


#: Token ids one after another, and how many each stretch has.
Ids = tuple[np.ndarray, np.ndarray]


@dataclass
class Csr:
    """A sparse matrix: the columns of row i are indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def part(self, i: int, j: int) -> Csr:
        a, b = self.indptr[i], self.indptr[j]
        return Csr(self.indptr[i : j + 1] - a, self.indices[a:b], self.data[a:b], self.width)


def csr(rows: np.ndarray, columns: np.ndarray, data: np.ndarray, shape: tuple[int, int]) -> Csr:
    """From entries in any order; equal places are added up."""
    key = rows * np.int64(max(1, shape[1])) + columns
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, data = key[order], data[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    data = np.add.reduceat(data, first) if len(key) else data
    key = key[first]
    indptr = np.zeros(shape[0] + 1, np.int64)
    np.cumsum(np.bincount(key // max(1, shape[1]), minlength=shape[0]), out=indptr[1:])
    return Csr(indptr, key % max(1, shape[1]), data, shape[1])


def transposed(a: Csr) -> Csr:
    return csr(a.indices, a.row_of(), a.data, (a.width, a.rows))


def gustavson(a: Csr, b: Csr) -> Csr:
    """a . b row by row: the row of b named by each entry of a row of a, scaled, is added
    to that row of the product."""
    per_entry = np.diff(b.indptr)[a.indices]
    ends = np.cumsum(per_entry)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - per_entry, per_entry)
    place = np.repeat(b.indptr[a.indices], per_entry) + inside
    return csr(np.repeat(a.row_of(), per_entry), b.indices[place], np.repeat(a.data, per_entry) * b.data[place], (a.rows, b.width))


def incidence(lengths: np.ndarray, at: np.ndarray | None = None) -> Csr:
    """Tokens by what they cover: ``lengths`` consecutive columns each, named by ``at``."""
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    indices = np.arange(indptr[-1]) if at is None else at
    return Csr(indptr, indices, np.ones(len(indices), np.int64), int(indices.max(initial=-1)) + 1)


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.fast = None
        self.b = SentencePieceProcessor(model_file=piece_file)
        # byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in plain]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte_of.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
        model = json.loads(self.a.to_str())
        order = [names_of[0] + names_of[1] for names_of in model["model"]["merges"]]
        special = {t["id"] for t in model["added_tokens"]}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if i not in special}
        in_order = len(vocabulary) == 256 + len(order) and all(vocabulary.get(t) == 256 + i for i, t in enumerate(order))
        if in_order and model["pre_tokenizer"] == BYTE_LEVEL:
            import tiktoken

            # ids in the order of merges are ranks: the same encoding by a faster engine
            ranks = {self.a_bytes[i]: i for i in vocabulary.values()}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes)]
        self.names = [str(i) for i in range(max(map(len, self.sizes)))]
        self.space = self.b.piece_to_id("▁")
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def lengths(self, of: list[bytes]) -> np.ndarray:
        return self.sizes[0] if of is self.a_bytes else self.sizes[1]

    def stretches(self, text: str) -> list[str]:
        whole = " " + text
        return _CUT.split(whole) if self.cuts else [whole]

    def encode(self, parts: list[str]) -> tuple[Ids, Ids]:
        """Ids of stretches, each of which starts with a space; the pieces' model adds it.
        A run at a time: an encoding takes many times the memory of its ids."""
        out = [(array("i"), array("q")), (array("i"), array("q"))]
        at = 0
        while at < len(parts):
            to, size = at + 1, len(parts[at])
            while to < len(parts) and size + len(parts[to]) <= RUN_CHARS:
                size += len(parts[to])
                to += 1
            run = parts[at:to]
            first = list(map(self.fast.encode_ordinary, run)) if self.fast else [e.ids for e in self.a.encode_batch_fast(run, add_special_tokens=False)]
            second = self.b.encode([p[1:] for p in run], num_threads=1)
            if " " in run:
                second = [ids if len(p) > 1 else [self.space] for p, ids in zip(run, second)]
            for (ids, counts), own in zip(out, (first, second)):
                ids.extend(chain.from_iterable(own))
                counts.extend(map(len, own))
            at = to
        return tuple((np.frombuffer(i, np.int32).astype(np.int64) if i else np.zeros(0, np.int64), np.frombuffer(n, np.int64) if n else np.zeros(0, np.int64)) for i, n in out)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(byte_file: str, piece_file: str) -> Pair:
    key = (byte_file, piece_file)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


@dataclass
class Aligned:
    """Distinct stretches: ids of their tokens (A and B), which stretches both tokenizers
    reproduce, and the products. ``tokens_a`` and ``tokens_b`` are cut by stretch."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    good: np.ndarray
    overlap: Csr
    groups_a: Csr
    groups_b: Csr
    group_cuts: np.ndarray

    def shared_groups(self) -> Csr:
        """Tokens of A by tokens of B with a group in common. Whole, so its size is the sum
        over groups of the product of both token counts; take ``part`` rows where large."""
        return gustavson(self.groups_a, transposed(self.groups_b))


def align(parts: list[str], both: Pair) -> Aligned:
    """Products of distinct stretches, side by side as one block-diagonal matrix."""
    encoded, sizes = both.encode(parts), np.array([len(p.encode()) for p in parts], np.int64)
    raw, good = np.frombuffer("".join(parts).encode(), np.uint8), np.ones(len(parts), bool)
    starts = np.cumsum(sizes) - sizes
    for (ids, counts), of in zip(encoded, (both.a_bytes, both.b_bytes)):
        # bytes of the tokens of each stretch: as many as its own, and the same
        of_stretch = np.repeat(np.arange(len(parts)), counts)
        length = both.lengths(of)[ids]
        good &= np.bincount(of_stretch, length, minlength=len(parts)).astype(np.int64) == sizes
        fit = good[of_stretch]
        own = np.frombuffer(b"".join(map(of.__getitem__, ids[fit].tolist())), np.uint8)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes * good) - sizes * good, sizes * good) + np.repeat(starts, sizes * good)
        good[np.searchsorted(starts, at[raw[at] != own], "right") - 1] = False
    fits = [np.repeat(good, counts) for _, counts in encoded]
    cuts_a, cuts_b = (np.concatenate([[0], np.cumsum(np.where(good, counts, 0))]) for _, counts in encoded)
    ids_a, ids_b = (ids[fit] for (ids, _), fit in zip(encoded, fits))
    len_a, len_b = both.lengths(both.a_bytes)[ids_a], both.lengths(both.b_bytes)[ids_b]
    rows_a, rows_b = incidence(len_a), incidence(len_b)
    overlap = gustavson(rows_a, transposed(rows_b))
    # a byte's group: how many offsets before it end a token of both
    size = int(len_a.sum())
    ends = np.zeros(size + 1, np.int64)
    ends[np.intersect1d(np.cumsum(len_a), np.cumsum(len_b), assume_unique=True)] = 1
    group = np.cumsum(ends)[:-1]
    starts_a, starts_b = np.cumsum(len_a) - len_a, np.cumsum(len_b) - len_b
    n = int(ends.sum())
    groups_a, groups_b = (Csr(np.arange(len(s) + 1), group[s], np.ones(len(s), np.int64), n) for s in (starts_a, starts_b))
    group_cuts = np.concatenate([[0], np.cumsum(ends)[np.cumsum(sizes * good)]])
    return Aligned(ids_a, ids_b, cuts_a, cuts_b, good, overlap, groups_a, groups_b, group_cuts)


def written_groups(x: Aligned, names: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each stretch; ``names`` are the ids as text."""
    by_group = []
    for ids, member in ((x.ids_a, x.groups_a), (x.ids_b, x.groups_b)):
        cuts = np.searchsorted(member.indices, np.arange(member.width + 1))
        first = [names[t] for t in ids[cuts[:-1]].tolist()]
        for g in np.flatnonzero(np.diff(cuts) > 1).tolist():
            first[g] = ",".join([names[t] for t in ids[cuts[g] : cuts[g + 1]].tolist()])
        by_group.append(first)
    both = list(map("|".join, zip(*by_group)))
    cuts = x.group_cuts.tolist()
    return [";".join(both[i:j]) for i, j in zip(cuts, cuts[1:])]


@dataclass
class Block:
    """Documents of a block by stretches, and stretches by linked id pairs."""

    use: np.ndarray
    documents: Csr
    pairs: Csr
    pair_ids: np.ndarray
    counts: np.ndarray
    digests: list[str]


def block(texts: list[str | None], both: Pair) -> Block:
    """Aligns the texts of a block."""
    known: dict[str, int] = {}
    cut = [[known.setdefault(p, len(known)) for p in both.stretches(t)] if t else [] for t in texts]
    x = align(list(known), both)
    bad = ~x.good
    written = written_groups(x, both.names)
    # links of each stretch by (A id, B id), with their number
    i, j = x.overlap.row_of(), x.overlap.indices
    key = x.ids_a[i] * np.int64(len(both.b_bytes)) + x.ids_b[j]
    pair_ids, column = np.unique(key, return_inverse=True)
    stretch = np.searchsorted(x.cuts_a, i, "right") - 1
    pairs = csr(stretch, column, np.ones(len(i), np.int64), (len(known), len(pair_ids)))
    links = np.zeros(len(known), np.int64)
    np.add.at(links, stretch, 1)
    group_a = np.bincount(x.groups_a.indices, minlength=x.groups_a.width)
    group_b = np.bincount(x.groups_b.indices, minlength=x.groups_b.width)
    shared = np.concatenate([[0], np.cumsum(group_a * group_b)])[x.group_cuts]
    per = np.stack([np.diff(x.cuts_a), np.diff(x.cuts_b), np.diff(x.group_cuts), links, np.diff(shared)], axis=1)
    use = np.zeros(len(texts), bool)
    counts, digests = np.zeros((len(texts), per.shape[1]), np.int64), []
    rows, columns = [], []
    for d, own in enumerate(cut):
        at = np.array(own, np.int64)
        if not own or bad[at].any():
            digests.append("")
            continue
        use[d] = True
        counts[d] = per[at].sum(axis=0)
        digests.append(hashlib.sha256(";".join([written[s] for s in own]).encode()).hexdigest())
        rows.append(np.full(len(at), d, np.int64))
        columns.append(at)
    rows, columns = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, columns))
    documents = csr(rows, columns, np.ones(len(rows), np.int64), (len(texts), len(known)))
    return Block(use, documents, pairs, pair_ids, counts, digests)


def document_links(b: Block) -> Iterator[tuple[int, Csr]]:
    """Documents by id pairs (entries: links), for runs of documents from a first one on."""
    at = 0
    while at < b.documents.rows:
        to = max(at + 1, int(np.searchsorted(b.documents.indptr, b.documents.indptr[at] + SLICE, "right")) - 1)
        to = min(to, b.documents.rows)
        yield at, gustavson(b.documents.part(at, to), b.pairs)
        at = to


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
BLOCKS = "span long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, at binary, times binary, pairs array<long>, held array<long>"
SUMS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in their smallest unsigned type, its width first."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _align_blocks(byte_file: str, piece_file: str):
    """One row a document (its counts and links as packed places in the block's pairs) and
    one a block (its id pairs and how many of its documents hold each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, span = pair(byte_file, piece_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            _, offsets = hashing.buffers(texts)
            for i, j in hashing.slices(offsets, BLOCK_BYTES):
                b = block(texts.slice(i, j - i).to_pylist(), both)
                at, times, held = [], [], np.zeros(len(b.pair_ids), np.int64)
                for _, part in document_links(b):
                    held += np.bincount(part.indices, minlength=len(held))
                    for r in range(part.rows):
                        own = slice(part.indptr[r], part.indptr[r + 1])
                        at.append(_packed(part.indices[own]))
                        times.append(_packed(part.data[own]))
                n = j - i
                spare = pa.nulls(1, pa.int64())
                counts = [pa.concat_arrays([pa.array(b.counts[:, c]), spare]) for c in range(len(COUNTS))]
                lists = [pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([v], pa.list_(pa.int64()))]) for v in (b.pair_ids, held)]
                packed = [pa.array([*v, None], pa.binary()) for v in (at, times)]
                ids = pa.concat_arrays([batch.column("doc_id").slice(i, n), spare])
                names = ["span", "doc_id", *COUNTS, "groups_sha256", "at", "times", "pairs", "held"]
                yield pa.RecordBatch.from_arrays([pa.array([span] * (n + 1), pa.int64()), ids, *counts, pa.array([*b.digests, None]), *packed, *lists], names=names)
                span += 1

    return run


def _sum_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Left: a block's documents. Right: its id pairs by place, with their counts."""
    size = int(right.column("place").to_numpy().max(initial=-1)) + 1 if right.num_rows else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if right.num_rows:
        place = right.column("place").to_numpy()
        count[place] = right.column("n_docs").to_numpy()
        best[place] = right.column("is_best").to_numpy()
    n_best, count_sum = [], []
    for at, times in zip(left.column("at").to_pylist(), left.column("times").to_pylist()):
        at, times = _unpacked(at), _unpacked(times)
        n_best.append(int((times * best[at]).sum()))
        count_sum.append(int((times * count[at]).sum()))
    return left.select(["doc_id", *COUNTS, "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def files() -> tuple[str, str]:
    """The two vocabularies of the installed package of public tokenizers."""
    public = importlib.import_module("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def compare(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row a document: tokens of both, groups, overlap links, links within groups,
    links that are the A id's commonest, and the sum of the links' counts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = cut_lineage(narrow.mapInArrow(_align_blocks(byte_file, piece_file), BLOCKS))
    listed = blocks.filter("pairs IS NOT NULL").select("span", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).filter("p.held > 0").select("span", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    totals = listed.groupBy("pair").agg(F.sum("held").alias("n_docs"))
    b_ids = F.lit(pieces_in(piece_file)).cast("long")
    of_a = Window.partitionBy(F.floor(F.col("pair") / b_ids))
    ranked = cut_lineage(totals.withColumn("is_best", (F.col("n_docs") == F.max("n_docs").over(of_a)).cast("long")))
    back = listed.join(ranked, "pair").select(F.col("span").alias("of_span"), "place", "n_docs", "is_best")
    rows = blocks.filter("pairs IS NULL").drop("pairs", "held")
    return rows.groupBy("span").cogroup(back.groupBy("of_span")).applyInArrow(_sum_block, SUMS)


def pieces_in(piece_file: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_file).get_piece_size()
