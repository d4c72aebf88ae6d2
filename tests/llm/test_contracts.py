"""The queries against brute force over the whole tables of the smallest size."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from boutline.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_op1_fills_targets(spark, sf, docs):
    got = rows(spark, sf, "op1_source_mix")
    size = {d["doc_id"]: len(SPACE.findall(d["text"] or "")) for d in docs}
    by = defaultdict(int)
    for d in docs:
        by[d["source"]] += size[d["doc_id"]]
    names = sorted(by)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(by.values()), set()
    while True:
        rest = total - sum(3 * by[s] for s in capped)
        level = rest / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * by[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * by[s] if s in capped else weight[s] * level for s in names}
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by[s]) and abs(r.target - target[s]) < 1e-6 * target[s]
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, sf, "op1_source_mix")))


def test_op2_finds_planted_passages(spark, sf, docs):
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]}
    got = {(r.doc_id, r.item_id) for r in rows(spark, sf, "op2_benchmark_templates")}
    assert want <= got and len(got) <= len(want) + 1


def test_op3_held_out_accuracy(spark, sf, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    got = rows(spark, sf, "op3_language_ftrl")
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_op4_finds_notices(spark, sf, docs):
    notices = {"MIT": "released under the mit license", "Apache-2.0": "licensed under the apache license version 2 0", "GPL-3.0": "this work is licensed under the gnu general public license version 3", "CC-BY-NC-4.0": "licensed under cc by nc 4 0"}
    want = set()
    for d in docs:
        plain = f" {' '.join(re.findall(r'[^\W_]+', d['text'].lower()))} "
        want |= {(d["doc_id"], k) for k, v in notices.items() if f" {v} " in plain}
    assert {(r.doc_id, r.license) for r in rows(spark, sf, "op4_license_bands")} == want


def test_op5_removes_what_earlier_documents_hold(spark, sf, docs, monkeypatch):
    from boutline.llm import substrings

    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1 << 16)  # several blocks
    first, words = {}, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        w = words[d["doc_id"]] = (d["text"] or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d["doc_id"])
    got = {r.doc_id: r for r in rows(spark, sf, "op5_countmin_substrings")}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_op6_scores(spark, sf, docs, monkeypatch):
    from boutline.llm import automaton

    monkeypatch.setattr(automaton, "BLOCK_BYTES", 1 << 16)
    tokens = {d["doc_id"]: [*(d["text"] or "").encode().lower().split(), b"</s>"] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c, b = Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
            b.update(zip([b"<s>", *w[:-1]], w, strict=True))
    n, v, after, seen = sum(c.values()), len(c), Counter(u for u, _ in b), Counter()
    for (u, _), k in b.items():
        seen[u] += k
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda u, w: (b[u, w] + after[u] * p1(w)) / (seen[u] + after[u]) if seen[u] else p1(w)
    for u in [b"<s>", *list(c)[:20]]:  # a distribution over the words and the unknown
        assert abs(sum(p2(u, w) for w in c) + p2(u, b"\0unknown") - 1) < 1e-9
    for r in rows(spark, sf, "op6_backoff_automaton"):
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(p1(x)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p2(u, x)) for u, x in zip([b"<s>", *w[:-1]], w, strict=True)), rel_tol=1e-9)


def components(sets):
    where, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_op7_components(spark, sf, docs):
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    want = components(sets)
    for r in rows(spark, sf, "op7_minhash_near_dedup"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op8_round_trip(spark, sf):
    talks = defaultdict(list)
    for t in sorted(pq.read_table(f"{sf}/conversations.parquet").to_pylist(), key=lambda t: (t["conv_id"], t["turn"])):
        talks[t["conv_id"]].append((t["role"], t["text"] or ""))
    talks[-7] = [(r, "\\### Assistant: </turn> ok") for r in ("user", "assistant")]
    got = {r.conv_id: r for r in rows(spark, sf, "op8_prefix_targets")}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), digest(loss))


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def base_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(n - 9 if n > 9 else n for n in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op9_base_spans_stay(spark, sf, docs):
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in rows(spark, sf, "op9_personal_data"):
        base = base_spans(text[r.doc_id])
        assert r.base_sha256 == digest(",".join(base)) and r.spans.split(",")[: len(base)] == (base or [""])[: len(base)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k, _ in KINDS]


def test_op9_odd_texts(spark):
    from boutline.llm import pii

    odd = ["a@b.c@d.e.f", "x%a@b.cd%y@e.f", "..a.b@-.c.", "abc@%%x@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "4111-1111 1111-1111", "4111  1111111111111", "+1 (2) 345-678-9 ", "+1((((",
           "a@b..c @x.y z@w.q-.r_", "é a@b.c +49 (0) 123.456-789 1.1.1.1", None, "", "a" * 50_000 + "@", "1" * 20_000, "1 " * 20_000, "a@" + "b." * 10_000 + "c", "1.1." * 10_000]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.base_sha256 for r in pii.report(d).collect()}
    assert got == {i: digest(",".join(base_spans(t))) for i, t in enumerate(odd)}


def test_op10_measures(spark, sf, docs):
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    for r in rows(spark, sf, "op10_line_first_quality"):
        t = text[r.doc_id]
        w = SPACE.findall(t)
        often = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = set()
        for k in range(len(w) - 7):
            if often[tuple(w[k : k + 8])] > 1:
                again |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)
        assert not (r.base_failed and r.kept)
