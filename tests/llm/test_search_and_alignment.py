"""Exact vector search, ranked term search and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boutline.llm import alignment, lexical, pivots
from boutline.llm.queries import QUERIES

CLASHES = "text string, lang string, dim int, pivot int, ring int, score string, rank int, span string, term string, n_a string, label double"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_top(rows, k, asks):
    kept = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, q in kept:
        if asks(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_bytes": 600, "chunk_queries": 3}])
def test_vectors_of_all_kinds(spark, sizes):
    r = random.Random(5)
    near = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in near[i % 5]]) for i in range(400)]
    rows += [(1000 + i, near[0]) for i in range(150)]  # one common vector: ties everywhere
    rows += [(10, rows[10][1])] * 3  # repeated rows
    rows += [(2000, None), (2010, [1.0, None, 1, 1, 1, 1]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (None, near[1])]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (4000, []), (4010, []), (5000, [0.0] * 6), (6000, [1e30] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, "x", "y", 1, 2, 3, "s", 4, "a", "b", "c", 0.5) for i, v in rows], f"vec_id long, embedding array<float>, {CLASHES}")
    got = [tuple(x) for x in pivots.top_k(table, F.col("vec_id") % 10 == 0, 5, **sizes).collect()]
    want = brute_top([(i, v) for i, v in rows if i != 6000], 5, lambda i: i % 10 == 0)
    assert len(got) == len(set(got)) and set(got) == want


def test_bounds_leave_cells_out():
    """Far annuli are not scored, and the result stays that of all vectors."""
    r = np.random.default_rng(1)
    side = np.where(np.arange(4096) % 2, 1, -1)[:, None]
    vectors = np.floor(r.normal(size=(4096, 8)) * 5 + 100 * side)
    longest = float((vectors**2).sum(axis=1).max())
    lifted = np.concatenate([vectors, np.sqrt(longest - (vectors**2).sum(axis=1))[:, None]], axis=1)
    far = np.sqrt(((lifted - lifted[0]) ** 2).sum(axis=1))
    order = np.argsort(far, kind="stable")
    vectors, far, ids = vectors[order], far[order], order.astype(np.int64)
    q = vectors[ids == 0]
    away = np.sqrt(((np.concatenate([q, [[0.0]]], axis=1) - lifted[0]) ** 2).sum(axis=1))
    seen, plain = [], pivots._products
    pivots._products = lambda a, b: seen.append(len(b)) or plain(a, b)
    try:
        _, found, score = pivots.search_cell(ids, vectors, far, q, np.array([0]), away, np.array([-(1 << 63)]), longest, 5)
    finally:
        pivots._products = plain
    everything = (vectors @ q[0]).astype(np.int64)
    best = np.lexsort((ids, -everything))
    best = best[ids[best] != 0][:5]
    assert sorted(zip(-score, found)) == sorted(zip(-everything[best], ids[best])) and sum(seen) < 4096


def test_vectors_of_an_empty_table(spark):
    assert pivots.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def brute_terms(docs, items, k):
    tokens = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in tokens if t), sum(len(t) for _, t in tokens)
    df = Counter(w for _, t in tokens for w in set(t))
    out = {}
    for item, text in set(items):
        scored = []
        for i, t in tokens:
            tf, m = Counter(t), 25 + (75 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in TERM.findall((text or "").translate(LOWER)) if tf[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out[item] = [(r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"bundle_items": 2, "term_rows": 0}])
def test_terms_of_all_kinds(spark, sizes, monkeypatch):
    r = random.Random(2)
    names = [f"w{i}" for i in range(60)] + ["Über", "naïve", "7"]
    texts = [" ".join(r.choices(names, [1 / (1 + i) for i in range(63)], k=r.randint(1, 60))) for _ in range(300)]
    docs = list(enumerate(texts)) + [(900 + i, "the same w3 w50 text") for i in range(40)]
    docs += [(5, texts[5])] * 2 + [(None, texts[7]), (None, None), (800, ""), (801, "!?"), (802, "W1\u0000w1,ÜBER über"), (803, "w2 " * 50_000)]
    items = [(i, " ".join(r.choices(names, k=12))) for i in range(9)] + [(20, None), (21, ""), (22, "unheard of"), (23, "w50 w50 the same"), (23, "w50 w50 the same"), (None, "w1")]
    table = spark.createDataFrame([(i, t, "x", 1, 2, 3, "s", 4, "a", "b", "c", 0.5) for i, t in docs], "doc_id long, " + CLASHES).repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    monkeypatch.setattr(lexical, "RANGE_ROWS", 16)
    got = defaultdict(list)
    for x in lexical.search(table, asked, 10, **sizes).orderBy("item_id", "rank").collect():
        got[x.item_id].append((x.rank, x.doc_id, x.score))
    assert dict(got) == {k: v for k, v in brute_terms(docs, items, 10).items() if v}


def test_terms_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = one.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(none, item).count() == 0 and lexical.search(one, item.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), item).count() == 0


def brute_alignment(docs, both):
    """Every text encoded whole, links and groups by walking both lists of tokens."""
    rows, links = [], []
    for i, text in docs:
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(both.a_bytes[t] for t in a) != raw or b"".join(both.b_bytes[t] for t in b) != raw:
            a = b = []
        spans = []
        for ids, of in ((a, both.a_bytes), (b, both.b_bytes)):
            at, own = 0, []
            for t in ids:
                own.append((at, at + len(of[t]), t))
                at += len(of[t])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for e in ends:
            groups.append(tuple([t for s, _, t in own if start <= s < e] for own in spans))
            start = e
        met, j = [], 0
        for s, e, t in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                met.append((t, spans[1][k][2]))
                k += 1
        links.append(met)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append([i, len(a), len(b), len(groups), len(met), hashlib.sha256(text_of.encode()).hexdigest() if a else ""])
    count = Counter(p for met in links for p in set(met))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted((*row, sum(count[p] == best[p[0]] for p in met), sum(count[p] for p in met)) for row, met in zip(rows, links))


def columns(df):
    return sorted((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256, x.n_best, x.count_sum) for x in df.collect())


def test_op13_against_whole_texts(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert columns(QUERIES["op13_token_incidence"](spark, sf)) == brute_alignment(docs, alignment.pair(*alignment.files()))


def test_alignment_of_all_kinds(spark, monkeypatch):
    r = random.Random(8)
    texts = [None, "", " ", "  ", "a ", " a", "a  b   c", "tail \n", "\t x\n\n y", "don't we'll  it's", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ x▁y", "naïve café  über", "日本語 の テキスト。", "👩‍👩‍👧 🤷🏽", "a b   c", "\u0000 x \u007f", "é é", "١٢٣ १२३", "𝔘𝔫𝔦 ﬁ", "x" * 3000, " " * 500, "ab " * 4_000]
    texts += ["".join(r.choice("ab  .,é\n▁'1 ") for _ in range(60)) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6])] * 2
    table = spark.createDataFrame([(i, t, "x", 1, 2, 3, "s", 4, "a", "b", "c", 0.5) for i, t in docs], "doc_id long, " + CLASHES)
    want = brute_alignment(docs, alignment.pair(*alignment.files()))
    assert columns(alignment.compare(table, *alignment.files())) == want
    nulls = spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")
    assert sorted((x.n_a, x.groups_sha256 == "") for x in alignment.compare(nulls, *alignment.files()).collect()) == [(0, True), (1, False)]
    assert alignment.compare(table.limit(0), *alignment.files()).count() == 0


def dense(m):
    out = np.zeros((m.rows, m.width), np.int64)
    np.add.at(out, (m.row_of(), m.indices), m.data)
    return out


def test_products_equal_dense_ones():
    r = np.random.default_rng(3)
    for shape in [(4, 7, 5), (1, 1, 1), (6, 9, 3), (3, 0, 2)]:
        a, b = (alignment.csr(r.integers(0, max(1, x), 12)[: 12 if x * y else 0], r.integers(0, max(1, y), 12)[: 12 if x * y else 0], r.integers(1, 4, 12)[: 12 if x * y else 0], (x, y)) for x, y in (shape[:2], shape[1:]))
        assert (dense(alignment.gustavson(a, b)) == dense(a) @ dense(b)).all() and (dense(alignment.transposed(a)) == dense(a).T).all()


def test_shared_groups_are_the_links_within_groups():
    both = alignment.pair(*alignment.files())
    x = alignment.align([" hello", " cafés", " 日本語"], both)
    a, b = dense(x.groups_a), dense(x.groups_b)
    assert (dense(x.shared_groups()) == a @ b.T).all() and (dense(x.overlap)[dense(x.overlap) > 0] > 0).all()
    assert int((a.sum(axis=0) * b.sum(axis=0)).sum()) == len(x.shared_groups().indices)
