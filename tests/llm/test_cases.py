"""Nulls, empty and odd texts, ties, repeats, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from boutline.llm import automaton, chat, decontaminate, langid, licenses, minhash, mixing, pii, quality, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, label double, node int, kept string"


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(5))


@pytest.fixture(scope="module")
def cases(spark):
    r = random.Random(3)
    long = " ".join(word(r) for _ in range(400))
    near = long.split()
    near[100] = "changed"
    texts = [None, "", " \t\n", "one two", long, long, " ".join(near), "é" * 300, "\u0000  x", "a b c d e", "A B C D E"]
    data = [(i, t, "en" if i % 2 else "de", None if i % 3 == 0 else "s", None, "x", 1.0, 1, "y") for i, t in enumerate(texts)]
    data += [(4, long, None, "s", 3, "x", 1.0, 1, "y")] * 2 + [(None, long, "en", None, 3, "x", 1.0, 1, "y"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)



OPERATORS = {
    "quality": quality.judge,
    "mix": mixing.mix,
    "near": minhash.near_duplicates,
    "substrings": substrings.without_repeats,
    "pii": pii.report,
    "automaton": lambda d: automaton.score(d, F.lit(False)),
    "langid": lambda d: langid.identify(d, F.lit(False)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(cases, name):
    assert OPERATORS[name](cases).count() == cases.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_of_cases(cases):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(cases).collect()}
    assert (0, 0, 0) in got and (1, 1, 0) in got and (3, 3, 1) in got
    assert {c for d, c, _ in got if d in (4, 5, 6)} == {4} and {c for d, c, _ in got if d in (9, 10)} == {9}
    assert {c for d, c, _ in got if d is None} == {None}
    kept = [r.doc_id for r in minhash.one_of_each(cases).collect()]
    assert sorted(x for x in kept if x is not None) == [0, 1, 2, 3, 4, 7, 8, 9] and kept.count(None) == 2


def test_near_groups_need_no_common_hub(spark):
    """A chain of texts, each close to the next only, is one component."""
    r = random.Random(9)
    w = [word(r) for _ in range(300)]
    texts = []
    for i in range(30):
        texts.append(" ".join(w))
        for k in range(4):
            w[(i * 37 + k * 61) % 300] = word(r)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in enumerate(texts)}
    parent = dict.fromkeys(sets, 0)
    parent = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((parent[i], parent[j]))
                parent = {k: a if v == b else v for k, v in parent.items()}
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(d).collect()} == parent


def test_substrings_of_cases(cases):
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in substrings.without_repeats(cases).collect())
    assert got[:4] == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 2, 0)]
    # rows of one doc_id do not remove each other; the later copy, and a null id, go whole
    assert [x for x in got if x[0] == 4] == [(4, 400, 0)] * 3 and (5, 400, 400) in got and (99, 400, 400) in got and (6, 400, 399) in got


def test_mix_of_nothing_and_of_one(spark):
    d = spark.createDataFrame([(1, "a b c", "s"), (2, None, "t"), (3, "", None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix(d).collect()}
    assert got == {1: (3, 3), 2: (0, 0), 3: (0, 0)}


def test_mix_repeats_up_to_three_times(spark):
    d = spark.createDataFrame([(i, "w " * 10, "a" if i else "b") for i in range(10)], "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix(d, block_words=8).collect()}
    assert got[0] == 30 and sum(got.values()) == 100 and max(got.values()) <= 30


def test_mix_follows_its_schedule(spark, monkeypatch):
    """After any k slots each source has had its share to within a few slots, and another
    order of slots gives another mix."""
    d = spark.createDataFrame([(i, "w " * (5 + i % 40), "abc"[min(2, i % 7 // 2)]) for i in range(900)], "doc_id long, text string, source string")
    mixed = mixing.mix(d, block_words=16)
    rows = [(r.slot, r.source, r.words, r.doc_id) for r in mixing.in_order(mixed, "source", "doc_id").collect()]
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == {i: sum(w for _, _, w, j in rows if j == i) for i in {r[3] for r in rows}}
    owner = {slot: source for slot, source, _, _ in rows}
    goal = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    total, seen = sum(goal.values()), dict.fromkeys(goal, 0)
    worst = 0.0
    for k, slot in enumerate(sorted(owner), 1):
        seen[owner[slot]] += 1
        worst = max(worst, max(abs(seen[s] - k * goal[s] / total) for s in goal))
    assert worst < 8
    assert all(r.first_slot == r.slots[0].slot for r in mixed.collect() if r.slots) and mixed.filter("slots is null and taken > 0").count() == 0

    def plain(spark, shares, slots):
        up = shares.select("_key", "_slots").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1)))
        return up.select((F.xxhash64("_key") % 7 * 100_000 + F.col("_block")).alias("_slot"), "_key", "_block")

    before = {(r.doc_id, r.first_slot) for r in mixed.collect()}
    monkeypatch.setattr(mixing, "schedule", plain)
    assert {(r.doc_id, r.first_slot) for r in mixing.mix(d, block_words=16).collect()} != before


def test_templates(spark):
    b = spark.createDataFrame([(1, "If Tom has 12 apples and then Tom gives Mary 5 apples over 3 days, how many apples does Tom have left"), (2, None), (3, "short one"), (4, "")], "item_id long, text string")
    docs = [
        (10, "Intro. If Ann has 30 apples and then Ann gives Lisa 7 apples over 9 days, how many apples does Ann have left? ok"),
        (11, "If Ann has 30 apples and then Bob gives Cid 7 apples over 9 days, how many apples does Dan have left"),
        (12, None),
        (None, "x if tom has 12 apples and then tom gives mary 5 apples over 3 days, how many apples does tom have left"),
        (13, "a clean text"),
    ]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()} == {(10, 1), (None, 1)}
    left = decontaminate.without_leaks(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [11, 12, 13]
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0


def test_verbatim_items_dense_in_slots_or_short(spark):
    items = ["Who wrote The Old Man and the Sea, Ernest Hemingway, John Steinbeck or William Faulkner", "Compute 17 * 24 + 9 - 3 * 8 / 2", "Solve x + 5 = 12", "小明有五个苹果"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, f"Some words before it: {t}. And some after.") for i, t in enumerate(items)] + [(9, "Compute 1 * 2 + 3 - 4. Solve y + 5 = 13, who wrote the old 小明有"), (3, f"问题:{items[3]}吗")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 3)]
    assert [r.doc_id for r in decontaminate.without_leaks(d, b).collect()] == [9]


def test_items_of_one_word_are_lines(spark):
    b = spark.createDataFrame([(1, "Paris"), (2, "two words"), (3, "水")], "item_id long, text string")
    docs = [(1, "The city of Paris is fine."), (2, "Capital?\n  paris!\nyes"), (3, "Here two, words stand"), (4, "Paris"), (5, "我喝水\n水"), (6, "我喝水"), (7, None), (4, "Paris")]
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, window int, variant string, item_id string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(d, b).select("doc_id", "item_id").distinct().collect()) == [(2, 1), (3, 2), (4, 1), (5, 3)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(d, b).collect()) == [1, 6, 7] and decontaminate.without_leaks(d, b).columns == d.columns


def test_leaks_in_very_long_and_repeated_texts(spark):
    item = "how many red apples does a farmer pick in the old garden behind the mill"
    long = "filler words without any meaning " * 100_000
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(None, long + item), (None, long + item), (5, long), (6, item.upper()), (6, item.upper())], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()} == {(None, 1), (6, 1)}
    assert [r.doc_id for r in decontaminate.without_leaks(d, b).collect()] == [5]


def test_templates_against_brute_force(spark):
    """Generated items, re-parameterised copies and mixtures, judged by the same rules in Python."""
    r = random.Random(11)
    names = ["Tom", "Ann", "Lisa", "Bob", "Mary", "Carl"]
    made = []
    for _ in range(12):
        words = [word(r) for _ in range(24)]
        for at in r.sample(range(2, 24), 5):
            words[at] = "#" if r.random() < 0.5 else "@"
        made.append(words)

    def fill(words, rename, renumber):
        out, n = [], 0
        for w in words:
            if w == "#":
                n += 1
                w = str(renumber(n))
            elif w == "@":
                w = rename
            out.append(w)
        return out

    items = [fill(w, "Tom", lambda n: 10 + n) for w in made]
    docs, want = [], set()
    for i, w in enumerate(made):
        filler = [word(r) for _ in range(30)]
        docs.append((10 * i, filler[:10] + fill(w, r.choice(names), lambda n: 90 + 7 * n) + filler[10:]))
        want.add((10 * i, i))
        half = fill(w, "Ann", lambda n: n)
        docs.append((10 * i + 1, half[:6] + filler[:15] + half[18:]))  # too little of it
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")

    def template(tokens):
        return [("\ue000" if t.isdigit() else "\ue001" if t in names and k else t).lower() for k, t in enumerate(tokens)]

    def searched(tokens):
        return {tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4) if sum(t not in ("\ue000", "\ue001") for t in tokens[k : k + 5]) >= 3}

    brute = set()
    for i, t in docs:
        theirs = template(t)
        have = {tuple(theirs[k : k + 5]) for k in range(len(theirs) - 4)}
        for j, item in enumerate(items):
            need = searched(template(item))
            if 2 * len(need & have) >= len(need):
                brute.add((i, j))
    assert brute == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.matches(d, b).collect()} == brute


def test_numbers_that_coincide_by_chance(spark):
    told = "the basket of the old farmer has {} apples and another basket has {} pears while {} sits there and then {} eats some, how many fruits are left for {} now"
    one, two = told.format(5, 5, "Tom", "Tom", "Mary"), told.format(3, 4, "Tom", "Tom", "Mary")
    b = spark.createDataFrame([(1, one), (2, two.replace("basket", "wagon"))], "item_id long, text string")
    docs = [
        (1, told.format(3, 8, "Ann", "Ann", "Lisa")), (2, told.format(6, 6, "Ann", "Ann", "Lisa").replace("basket", "wagon")),
        (3, told.format(3, 8, "Ann", "Ann", "Lisa").replace("left for", "there for")), (4, told.format(6, 6, "Ann", "Ann", "Lisa").replace("basket", "wagon").replace("left for", "there for")),
        (8, told.format(3, 8, "Ann", "Bob", "Lisa")), (9, told.format(6, 6, "Ann", "Ann", "Ann").replace("basket", "wagon")),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert {(1, 1), (2, 2), (3, 1), (4, 2)} <= got and not {8, 9} & {d for d, _ in got}


def test_licenses_of_cases(spark):
    d = spark.createDataFrame([(1, "x Released, under the MIT License. y"), (2, None), (3, ""), (4, "released under the"), (None, "Licensed under CC BY-NC 4.0."), (1, "x Released, under the MIT License. y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license) for r in licenses.scan(d).collect()) == [(0, "CC-BY-NC-4.0"), (1, "MIT")]
    assert licenses.scan(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(d, [("x", "too short")])


def test_chat_of_cases(spark):
    told = [(1, 0, "user", "<turn user>\n\\b \\l </turn>"), (1, 1, "assistant", None), (1, None, "assistant", "last"), (2, 0, None, "x"), (None, 0, "a>\n<b\\", "y"), (None, 5000, "assistant", "z\\"), (3, 0, "user", "only")]
    d = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    e = chat.expand(d)
    got = {r.conv_id: r for r in chat.report(e).collect()}
    from hashlib import sha256

    h = lambda s: sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == h("user\n<turn user>\n\\b \\l </turn>\nassistant\n\nassistant\nlast\n") and got[1].loss_sha256 == h("last")
    assert got[None].turns_sha256 == h("a>\n<b\\\ny\nassistant\nz\\\n") and got[None].loss_sha256 == h("z\\") and got[2].turns_sha256 == h("\nx\n")
    assert got[3].loss_chars == 0 and got[3].n_turns == 1
    x = {(r.conv_id, r.example): r for r in chat.examples(e).collect()}
    assert len(x) == 3 and x[1, 1].reply == "last" and x[1, 1].prompt.startswith("<turn user>\n\\lturn user>") and x[1, 1].prompt.endswith("<turn assistant>\n")
    assert chat.report(chat.expand(d.limit(0))).count() == 0


def test_chat_writes_each_example_out(spark, monkeypatch):
    """A row for every assistant turn, its prompt the whole text before it; the query reads those rows."""
    told = [(c, i, ("user", "assistant")[(i + c) % 2], f"<t{c}> \\{i}" * (i + 1)) for c in range(5) for i in range(c)]
    d = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    esc = lambda x: x.replace("\\", "\\b").replace("<", "\\l")
    want, whole = {}, {}
    for c, _, role, x in told:
        prompt = whole.get(c, "") + f"<turn {role}>\n"
        if role == "assistant":
            want[c, sum(k[0] == c for k in want)] = (prompt, esc(x))
        whole[c] = prompt + esc(x) + "</turn>\n"
    written = chat.expand(d).collect()
    assert {(r.conv_id, r.example): (r.prompt, r.reply) for r in written if r.example is not None} == want
    rest = {r.conv_id: r.prompt for r in written if r.example is None}
    for c, text in whole.items():
        own = [v for k, v in sorted(want.items()) if k[0] == c]
        assert ("".join(own[-1]) if own else "") + rest[c] == text
    from boutline.llm import queries

    seen = []
    monkeypatch.setattr(queries, "cut_lineage", lambda df: seen.append(df.columns) or df)
    assert queries.op8_prefix_targets(spark, "/root/testdata/sf0.001").count() > 0 and {"prompt", "reply"} <= set(seen[0])


def test_redaction(spark):
    d = spark.createDataFrame([(1, "mail a.b@c.de now 1.2.3.4", 3, "k"), (2, None, None, None), (3, "clean text", 10, "z")], "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    assert got[1].text == "mail [EMAIL] now [IP]" and got[1].n_chars == 21 and got[1].base == "k"
    assert got[2].text is None and got[3].text == "clean text" and got[3].n_chars == 10


def test_generators_add_by_format_and_context(spark):
    told = [
        ("Reach us at (555) 123-4567 today", ["(555) 123-4567"]), ("id 123-45-6789 on file", ["123-45-6789"]), ("call 5551234567 now", ["5551234567"]), ("write (555) 123-4567 (555) 765-4321", ["(555) 123-4567", "(555) 765-4321"]),
        ("password: correcthorsebattery", ["password: correcthorsebattery"]), ("kim [at] site [dot] org", ["kim [at] site [dot] org"]),
        ("apples @ 3.50 each", []), ("on 2024-01-15 we met", []), ("order 555123456789", []), ("total 12.500.000", []), ("password: required", []), ("token = get_token()", []),
    ]
    for part in (told, told[:1], told[4:5], told[6:7]):  # whether or not the corpus has the other kinds
        d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(part)], "doc_id long, text string")
        got = {r.doc_id: sorted(part[r.doc_id][0][s.start : s.stop] for s in r.added) for r in pii.find(d).collect()}
        assert got == {i: sorted(w) for i, (_, w) in enumerate(part)}
    assert [r.text for r in pii.redact(d).collect()] == ["apples @ 3.50 each"]


def test_trees_and_thresholds_count_every_candidate(spark, monkeypatch):
    """40,000 labelled candidates: three quarters are learned from, all others are held out."""
    seen, own = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii, "GROUP_WEIGHT", 1e9, raising=False)
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, data: seen.append((self.getOrDefault("maxBins") ** 2, data)) or own(self, data))
    text = F.concat(F.lit("call 555"), F.lpad(F.col("id").cast("string"), 7, "1"), F.lit(" or "), F.lit("mail ann"), F.col("id") % 100, F.lit("@host.org"))
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    added = pii.find(d).selectExpr("sum(size(added))", "sum(size(base))").first()
    bound, data = seen[0]
    weight = data.agg(F.sum("weight") if "weight" in data.columns else F.count("*")).first()[0]
    assert abs(weight - 0.75 * (40_000 + len(pii.EXAMPLES))) < 600 and data.count() < 1_000 < bound
    assert tuple(added) == (20_000, 20_000)


def test_every_candidate_is_learned_and_held_out_once(spark, monkeypatch):
    """Four parts, each held out of one fit and so judged once; the last fit has them all."""
    weights, own = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii, "GROUP_WEIGHT", 1e9, raising=False)
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, data: weights.append(data.agg(F.sum("weight")).first()[0]) or own(self, data))
    d = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call 555"), F.lpad(F.col("id").cast("string"), 7, "1")).alias("text"))
    pii.find(d).count()
    whole = weights[-1]
    assert len(weights) == pii.FOLDS + 1 and whole >= 2_000 + len(pii.EXAMPLES)
    assert sum(weights[:-1]) == (pii.FOLDS - 1) * whole


def test_mix_ends_in_a_small_plan(spark):
    """The schedule and what is taken are tables: no plan, which the driver holds, has the whole job."""
    d = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 50)) for i in range(200)], "doc_id long, source string, text string")
    plan = mixing.mix(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6


def test_long_secrets_and_contacts_go_whole(spark):
    secret = 'token = "' + "ab12" * 2_000
    contact = "k" * 500 + " [at] " + "site" * 100 + " [dot] " + "org" * 30
    told = [f'x {secret}" y', f"x {contact} y", "x" * 200_000 + " @", "x@" * 50_000, "token=" * 20_000, "(at)" * 20_000, "password=" + "ab-" * 50_000, "a @ " + "b." * 50_000 + "c"]
    d = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert got[0] == 'x [SECRET]" y' and got[1] == "x [CONTACT] y" and got[2] == told[2]


def test_cleaning(spark):
    prose = "\n".join(" ".join(f"word{i}{j}" for j in range(8)) for i in range(5))
    d = spark.createDataFrame([(1, prose + "\n### *** $$$\nClick here to read more", 1), (2, "home | news | about | contact | help\n" * 9, 1), (3, None, 1), (4, prose, 7)], "doc_id long, text string, n_words long")
    got = {r.doc_id: r for r in quality.clean(d).collect()}
    assert set(got) == {1, 4} and got[1].text == prose == got[4].text and got[4].n_words == 7


def test_language_without_learning_rows(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, "12", "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(d, F.lit(False)).collect()} == {("und", 0.0)}
    e = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("abc abc", "x"), ("déf déf", "y")] * 20)] + [(99, "1 2", "x"), (98, None, "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(e, F.lit(False)).collect()}
    assert (got[0].lang_pred, got[1].lang_pred, got[99].lang_pred, got[98].score) == ("x", "y", "und", 0.0)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.cut_lineage(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert decontaminate.matches(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert minhash.near_duplicates(docs).filter("not kept").count() == 0
    end = p.source_mix(spark, docs, sf)
    assert 0 < end.filter("taken > 0 and taken <= 3 * size").count() == end.count()
