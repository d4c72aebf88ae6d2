"""Removal of passages that an earlier document holds, with a count-min prefilter.

Documents are hashed to blocks and windows of 13 words to segments, both as many as the
bytes of the corpus ask for. Packed messages pass between them:

1. Each block sketches its windows for every segment: in two rows of cells, which cells
   it hits once and which twice or more (a sparse count-min sketch whose counts stop at
   two). There are as many cells a row as bytes of text, about six a window.
2. A segment merges the sketches of all blocks and answers each with the cells that are
   hit twice or more. Counts are only ever over-estimated, so no repeat is lost.
3. Of windows whose cells all are, a block sends the 96-bit key and its smallest
   document to the segment, which groups them exactly and answers with those that a
   smaller document of another block has.
4. The block removes the words under these windows and under those that a smaller
   document of its own has.

Every message goes once for a block and segment, a window that a third of all documents
hold is one entry a block, and no task holds more than a block or a segment.

Defined cases: null or blank texts have no words; a text of fewer than 13 words keeps
all; rows that share a doc_id do not remove each other's words; a null doc_id counts as
larger than all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm import hashing

WINDOW = 13
BLOCK_BYTES = 1 << 23
_LAST = np.iinfo(np.int64).max


class Windows:
    """Windows of the texts of a block: keys, the row each is in and its first word."""

    def __init__(self, texts: pa.ChunkedArray, segments: int, width: int) -> None:
        rows, at, one, two, counts, base = [], [], [], [], [], 0
        for w in hashing.words(texts):
            full = hashing.whole(w.offsets, WINDOW)
            rows.append(w.text_of()[full] + w.first)
            at.append(full + base)
            one.append(hashing.windows(w.hashes, WINDOW)[full])
            two.append(hashing.windows(w.hashes, WINDOW, 1)[full])
            counts.append(w.counts)
            base += len(w.hashes)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.rows, self.at = join(rows, np.int64), join(at, np.int64)
        self.one, self.two = join(one, np.uint64), join(two, np.uint64)
        self.counts = join(counts, np.int64)
        self.segment = ((self.one >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
        low = np.uint64(0xFFFFFFFF)
        self.cells = [((h & low) % np.uint64(width)).astype(np.uint32) for h in (self.one, self.two)]
        self.order = np.argsort(self.segment, kind="stable")
        self.cuts = np.searchsorted(self.segment[self.order], np.arange(segments + 1))

    def of(self, segment: int) -> np.ndarray:
        return self.order[self.cuts[segment] : self.cuts[segment + 1]]


def pack(values: np.ndarray) -> bytes:
    """A sorted array of 32-bit numbers as differences, in 16 bits where they fit."""
    steps = np.diff(values, prepend=np.uint32(0)).astype(np.uint32)
    small = not len(steps) or int(steps.max()) < 1 << 16
    return bytes([small]) + steps.astype(np.uint16 if small else np.uint32).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint16 if packed[0] else np.uint32, offset=1)
    return np.cumsum(steps, dtype=np.uint32)


def twice_at_most(cells: np.ndarray) -> np.ndarray:
    """Sorted, each value once or twice."""
    cells = np.sort(cells)
    if len(cells) < 3:
        return cells
    return cells[np.concatenate([[True, True], cells[2:] != cells[:-2]])]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


SKETCH = "segment long, block long, cells1 binary, cells2 binary"
ANSWER = "block long, segment long, hit1 binary, hit2 binary"
KEYS = "segment long, block long, one binary, two binary, first binary"
GONE = "block long, one binary"
KEPT = "doc_id long, n_words long, n_removed long, text string"


def _sketch(segments: int, width: int):
    def run(docs: pa.Table) -> pa.Table:
        block, w = docs.column("block")[0].as_py(), Windows(docs.column("text"), segments, width)
        rows = []
        for s in range(segments):
            own = w.of(s)
            if len(own):
                rows.append((s, block, *(pack(twice_at_most(c[own])) for c in w.cells)))
        return _table(SKETCH, rows)

    return run


def _merge(width: int):
    def run(sketches: pa.Table) -> pa.Table:
        segment, blocks = sketches.column("segment")[0].as_py(), sketches.column("block").to_pylist()
        hits = []
        for name in ("cells1", "cells2"):
            seen, often, own = np.zeros(width, bool), np.zeros(width, bool), []
            for packed in sketches.column(name):
                cells = unpack(packed.as_py())
                again = np.concatenate([[False], cells[1:] == cells[:-1]])
                often[cells[again]] = True
                once = cells[~again]
                often[once[seen[once]]] = True
                seen[once] = True
                own.append(once)
            hits.append([np.packbits(often[x]).tobytes() for x in own])
        return _table(ANSWER, list(zip(blocks, [segment] * len(blocks), *hits, strict=True)))

    return run


def _doc_ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").fill_null(_LAST).to_numpy()


def _likely(segments: int, width: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table(KEYS, [])
        block, ids = docs.column("block")[0].as_py(), _doc_ids(docs)
        w, rows = Windows(docs.column("text"), segments, width), []
        for s, *hits in zip(*(answers.column(c).to_pylist() for c in ("segment", "hit1", "hit2")), strict=True):
            own = w.of(s)
            often = np.ones(len(own), bool)
            for cells, hit in zip(w.cells, hits, strict=True):
                _, inverse = np.unique(cells[own], return_inverse=True)
                often &= np.unpackbits(np.frombuffer(hit, np.uint8))[inverse].astype(bool)
            own = own[often]
            if not len(own):
                continue
            one, two, first = w.one[own], (w.two[own] >> np.uint64(32)).astype(np.uint32), ids[w.rows[own]]
            order = np.lexsort((first, two, one))
            one, two, first = one[order], two[order], first[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            low = int(first[new].min())
            near = first[new] - low
            near = near.astype(np.uint32) if int(near.max()) < 1 << 32 else near
            rows.append((s, block, one[new].tobytes(), two[new].tobytes(), low.to_bytes(8, "little", signed=True) + bytes([near.itemsize]) + near.tobytes()))
        return _table(KEYS, rows)

    return run


def _resolve(keys: pa.Table) -> pa.Table:
    one, two, first, owner = [], [], [], []
    for i in range(keys.num_rows):
        a, b, c = (keys.column(n)[i].as_py() for n in ("one", "two", "first"))
        one.append(np.frombuffer(a, np.uint64))
        two.append(np.frombuffer(b, np.uint32))
        first.append(np.frombuffer(c, np.uint32 if c[8] == 4 else np.int64, offset=9).astype(np.int64) + int.from_bytes(c[:8], "little", signed=True))
        owner.append(np.full(len(one[-1]), i))
    one, two, first, owner = (np.concatenate(x) for x in (one, two, first, owner))
    order = np.lexsort((two, one))
    one, two, first, owner = one[order], two[order], first[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    least = np.repeat(np.minimum.reduceat(first, starts), np.diff(np.append(starts, len(one))))
    late = least < first
    blocks = keys.column("block").to_pylist()
    rows = []
    for i in range(keys.num_rows):
        gone = one[late & (owner == i)]
        if len(gone):
            rows.append((blocks[i], gone.tobytes()))
    return _table(GONE, rows)


def _remove(docs: pa.Table, gone: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _table(KEPT, [])
    ids, w = _doc_ids(docs), Windows(docs.column("text"), 1, 1)
    elsewhere = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in gone.column("one").to_pylist()] or [np.zeros(0, np.uint64)]))
    drop = np.zeros(len(w.one), bool)
    if len(elsewhere):
        drop = elsewhere[np.minimum(np.searchsorted(elsewhere, w.one), len(elsewhere) - 1)] == w.one
    # windows that a smaller document of the block has
    own = ids[w.rows]
    order = np.lexsort((own, w.two, w.one))
    one, two, doc = w.one[order], w.two[order], own[order]
    if len(order):
        starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        least = np.repeat(doc[starts], np.diff(np.append(starts, len(one))))
        drop[order[doc > least]] = True
    steps = np.zeros(int(w.counts.sum()) + 1, np.int64)
    np.add.at(steps, w.at[drop], 1)
    np.subtract.at(steps, w.at[drop] + WINDOW, 1)
    keep = np.cumsum(steps)[:-1] == 0
    data, offsets = hashing.buffers(docs.column("text"))
    ends = np.concatenate([[0], np.cumsum(w.counts)])
    kept, removed = [], []
    for i in range(docs.num_rows):
        own_keep = keep[ends[i] : ends[i + 1]]
        words = data[offsets[i] : offsets[i + 1]].tobytes().split()
        n = int(np.count_nonzero(own_keep))
        removed.append(len(words) - n)
        kept.append(b" ".join(words if n == len(words) else compress(words, own_keep.tolist())))
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(w.counts), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())})


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row of ``docs`` (doc_id, text): the
    words left, joined by one space."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    width = max(1024, total // blocks)
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("long").alias("block"))
    by_block = rows.groupBy("block")
    answers = by_block.applyInArrow(_sketch(blocks, width), SKETCH).groupBy("segment").applyInArrow(_merge(width), ANSWER)
    keys = by_block.cogroup(answers.groupBy("block")).applyInArrow(_likely(blocks, width), KEYS)
    gone = keys.groupBy("segment").applyInArrow(_resolve, GONE)
    return by_block.cogroup(gone.groupBy("block")).applyInArrow(_remove, KEPT)
