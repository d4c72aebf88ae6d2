"""Personal data by candidate gradient boosting.

Four base kinds are found by their patterns and format checks. Besides, high-recall
generators propose overlapping spans (anything that looks like an address, a number or a
secret); boosted trees score them by format and by the words before them; thresholds
calibrated on held-out candidates select the spans that are added. Base spans stay.
DataFrame functions and Spark ML on the JVM; texts are not shuffled.

The trees learn from candidates that format and context can label, whether or not they
are base spans: phones with a plus, national formats and numbers after a word for phone or
identity number are positive, plain ids, dates and amounts negative; contacts with a valid
domain are positive, those without negative; hexadecimal, mixed and word passwords are
positive, placeholders and code negative. All others are unlabelled and only scored. They
are fitted on all labelled candidates and ``EXAMPLES``, so that formats which a corpus
lacks or has rarely are known. Candidates with equal features and label are one row with
their number, so a fit on all of them reads few rows. A generator's label weighs at most
as much as ``GROUP_WEIGHT`` candidates, so that none drowns the others or the examples.
Each generator has its own threshold, from all labelled candidates that may be added:
each of the ``FOLDS`` parts (by hash) is scored by trees fitted on the others.

Patterns whose plain form could overflow Java's stack or take quadratic time on long runs
are written with a sentinel for a separator between two digits or a dot between two
labels, so that each is one class of characters; matches are the same.

Defined cases: a null or empty text has no spans; repeated rows are judged alike; a
generator whose held-out precision is too low at every threshold adds nothing; empty tables give no rows; extra
columns are ignored by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import let
from boutline.plans.bounded import bounded
from boutline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Weight of a corpus's candidates of one generator and label together, at most.
GROUP_WEIGHT = 1_666.0
PRECISION = 0.99
#: Parts of the labelled candidates, each held out once.
FOLDS = 4
CONTEXT_CHARS = 24

_SEP, _DOT, _OTHER = "\ue000", "\ue001", "\ue00f"
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
_EMAIL = f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]+{_DOT}[A-Za-z0-9{_DOT}-]+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_SEP}]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"

_DASHED = r"(?:1[ .-])?(?:(?:\([0-9]{3}\)[ ]?|[0-9]{3}-)[0-9]{3}[ .-][0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})"
_PAIRS = r"0[0-9](?:[ .-][0-9]{2}){4}"
_TRUNK = r"\(0[0-9]{1,4}\)[ ]?[0-9]{3,4}[ -]?[0-9]{3,4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -][0-9]{3,4}"
_IDENTITY = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Formats of national phones and identity numbers that are told without context.
NATIONAL = f"(?:{_DASHED}|{_PAIRS}|{_TRUNK}|{_IDENTITY})"
_DATE = r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}|(?:1[0-9]|20)[0-9]{2}[ ]?[-/][ ]?(?:1[0-9]|20)[0-9]{2})(?![0-9])"
_AMOUNT = r"^(?:[0-9.]+|[0-9]{1,3}(?:[ .][0-9]{3})+)$"
_CTX_PHONE = r"(?<!\p{L})(?:(?:tele)?(?:phone|fon)|tel|call|fax|mobile|cell|dial)(?!\p{L})[^0-9]{0,16}$"
_CTX_IDENTITY = r"(?<!\p{L})(?:ssn|social security|passport|tax id)(?!\p{L})[^0-9]{0,16}$"
_DOMAIN = r"(?:@|[\[(]at[\])]) ?[A-Za-z0-9](?!.*(?:\.\.|-\.|\.-).*[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,}[.-]*$"
_PLACEHOLDER = r"(?i)[=:]\x20{0,3}[\"']?(?:required|optional|string|null|none|true|false|undefined|unknown|invalid|expired|missing|hidden|redacted|your|example|changeme|placeholder|x{6,}|\*+|\.{3})|[(){}<>$\[\]]|://"
_WORD_PASSWORD = r"^(?i:pass(?:word|wd)?|pwd)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?(?:\p{L}{12,}|(?=\p{L}+[-_.]\p{L}+[-_.]\p{L})[\p{L}._-]{8,})$"
_MIXED_SECRET = r"^(?:(?i:pass|pwd)[^=:]*[=:]\x20{0,3}[\"']?(?=.{8})|[^=:]*[=:]\x20{0,3}[\"']?(?=.{16}))(?=[^0-9]*[0-9])(?=\P{L}*\p{L})"

# Characters of the part before an at sign, which may have any length, as secrets may.
_PART = r"^\x20\x09-\x0D<>\"(),;@\[\]"

#: Generators of candidates: name and pattern on the plain text.
GENERATORS = {
    "contact": f"(?:(?<![{_PART}])|\\G)[{_PART}]++" + r"(?: ?@ ?|(?: ?[\[(]at[\])] ?))[A-Za-z0-9-]++(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9.-]{2,}+",
    "number": f"(?<![0-9])(?<![0-9][./-]){NATIONAL}(?![0-9]|[./-][0-9])|" + r"\+?[(0-9][0-9() ./-]{7,30}[0-9]",
    "secret": r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?[^\x20\x09-\x0D\"',;]{6,}+",
}
FEATURES = ("n_chars", "n_digits", "n_letters", "n_other", "has_at", "has_plus", "n_dots", "n_marks", "octets", "luhn", "assigned", "hex", "ctx_mail", "ctx_phone", "ctx_card", "ctx_secret", "kind_contact", "kind_number", "national", "date", "amount", "ctx_number", "domain", "spaced", "placeholder", "word_password", "mixed_secret")


def _examples() -> list[str]:
    """Texts with candidates of every rule, eight of each."""
    forms = (
        "({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "1-{a}-{b}-{c}", "06 {d} {e} {d} {e}", "(0{d}) {c} {b}1", "{a}-{d}-{c}", "call {a}{b}{c}", "phone: {a} {b} {c}", "ssn {a}{d}{c}", "tel. {a}.{b}.{c}",
        "{a}{b}{c}", "{c}{c}{a}{b}", "2{a}{b}{e}", "201{f}-0{g}-1{g}", "1{g}/0{g}/199{g}", "19{d}-20{e}", "{a} {b} {a}", "{a}.{b}.{a}.00", "{a}{b}{c}.{d}", "1{g}.{f}.{a}.{c}",
        "user{d} [at] mail{e} [dot] org", "ann{d}(at)host{e}.net", "mail ann{d} @ host{e}.com", "kim.{d} [at] site.com", "apples @ {f}.{d}", "pears{d} @ {f}.{e}", "{d}pcs @ {e}.{d}", "oil @ {a}.{d}", "run{d}@{f}.{e}", "lot [at] {g}.{d}",
        "password: {w}{w}{w}", "passwd={w}{w}{w}", "pwd = '{w}-{w}-{w}'", "api_key = '{h}{h}{h}'", "token={h}{h}", "password=\"{w}{d}{h}\"",
        "password: required{g}", "token = get_{w}()", "secret: ${{{w}}}", "password=changeme{g}", "token: <{w}>", "password: string", "api_key: YOUR_{w}", "pwd: ******{g}",
    )
    names = ("river", "horse", "candle", "bright", "stone", "garden", "silver", "window")
    filled = lambda form, i: form.format(a=212 + 37 * i, b=345 + 41 * i, c=1207 + 613 * i, d=41 + 7 * i, e=13 + 9 * i, f=2 + i % 8, g=1 + i % 8, h=f"{0x3FA94C1B + 0x0B5D13F7 * i:08x}", w=names[i])
    return [filled(form, i) for form in forms for i in range(8)]


#: Candidates that are always among the learned and the held-out ones.
EXAMPLES = _examples()


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the matches: the stretches between matches and
    the matches themselves, laid end to end, give the places (in code points)."""

    def place(both: Column) -> Column:
        steps = F.zip_with(both["gaps"], both["hits"], lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), hit.alias("value")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            stop = start + s["hit"]
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), s["value"].alias("value")))).alias("out"))

        return F.aggregate(F.filter(steps, lambda s: s["value"].isNotNull()), none, step, lambda acc: acc["out"])

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether 13 to 19 digits pass the checksum."""

    def total(digits: Column) -> Column:
        def one(d: Column, i: Column) -> Column:
            n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return F.when(n > 9, n - 9).otherwise(n)

        return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), one), F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), total(d)).otherwise(F.lit(False)))


def _octets(value: Column) -> Column:
    return value.rlike(f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$")


_NONE = "array<struct<start:int,stop:int,value:string>>"


def base_spans(text: Column) -> Column:
    """array<struct<kind (index), start, stop>> of the base kinds, in their order."""
    none = F.array().cast(_NONE)

    def of_kind(k: int):
        return lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))

    def of(t: Column) -> Column:
        digits = t.rlike("[0-9]")
        found = [
            F.when(F.contains(t, F.lit("@")), _spans(F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT), _EMAIL)).otherwise(none),
            F.when(digits & t.rlike(_IP), F.filter(_spans(t, _IP), lambda s: _octets(s["value"]))).otherwise(none),
            F.when(digits & t.rlike(r"[0-9][\x20-]?[0-9]"), F.filter(_spans(F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP), _CARD), lambda s: _luhn(s["value"]))).otherwise(none),
            F.when(F.contains(t, F.lit("+")), F.filter(_spans(t, _PHONE), lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none),
        ]
        return F.concat(*(F.transform(x, of_kind(k)) for k, x in enumerate(found)))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_SEP}{_DOT}]", _OTHER), of)


def candidates(text: Column) -> Column:
    """array<struct<gen, start, stop, value, before>> of all generators; spans may overlap."""
    none = F.array().cast(_NONE)

    def told(t: Column, name: str):
        def one(s: Column) -> Column:
            before = F.lower(F.substring(t, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))))
            return F.struct(F.lit(name).alias("gen"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), before.alias("before"))

        return one

    def of(t: Column) -> Column:
        found = []
        for name, pattern in GENERATORS.items():
            hint = t.rlike(r"@|[\[(]at[\])]") if name == "contact" else t.rlike("[0-9]") if name == "number" else t.rlike("[=:]")
            spans = F.when(hint & t.rlike(pattern), _spans(t, pattern)).otherwise(none)
            found.append(F.transform(spans, told(t, name)))
        return F.concat(*found)

    return let(F.coalesce(text, F.lit("")), of)


def _features(c: DataFrame) -> DataFrame:
    v, before = F.col("value"), F.col("before")
    n_digits = F.regexp_count(v, F.lit("[0-9]"))
    n_letters = F.regexp_count(v, F.lit(r"\p{L}"))
    flag = lambda x: x.cast("int").cast("double")
    columns = {
        "n_chars": F.length(v), "n_digits": n_digits, "n_letters": n_letters, "n_other": F.length(v) - n_digits - n_letters,
        "has_at": flag(F.contains(v, F.lit("@"))), "has_plus": flag(F.contains(v, F.lit("+"))), "n_dots": F.regexp_count(v, F.lit(r"\.")), "n_marks": F.regexp_count(v, F.lit(r"[() /-]")),
        "octets": flag(_octets(v)), "luhn": flag(_luhn(v)), "assigned": flag(v.rlike("[=:]")), "hex": flag(v.rlike(r"[0-9a-f]{16,}")),
        "ctx_mail": flag(before.rlike("mail|contact|write")), "ctx_phone": flag(before.rlike(_CTX_PHONE)), "ctx_card": flag(before.rlike("card|visa|iban|account")), "ctx_secret": flag(before.rlike("pass|secret|token|key")),
        "kind_contact": flag(F.col("gen") == "contact"), "kind_number": flag(F.col("gen") == "number"),
        "national": flag((F.col("gen") == "number") & v.rlike(f"^{NATIONAL}$")), "date": flag((F.col("gen") == "number") & v.rlike(_DATE)), "amount": flag((F.col("gen") == "number") & v.rlike(_AMOUNT)), "ctx_number": flag(before.rlike(f"{_CTX_PHONE}|{_CTX_IDENTITY}")),
        "domain": flag((F.col("gen") == "contact") & F.regexp_replace(v, r" ?[\[(]dot[\])] ?", ".").rlike(_DOMAIN)), "spaced": flag((F.col("gen") == "contact") & v.rlike(" @|@ ")), "placeholder": flag((F.col("gen") == "secret") & v.rlike(_PLACEHOLDER)), "word_password": flag((F.col("gen") == "secret") & v.rlike(_WORD_PASSWORD)), "mixed_secret": flag((F.col("gen") == "secret") & v.rlike(_MIXED_SECRET)),
    }
    return c.withColumns({k: x.cast("double") for k, x in columns.items()})


def _labelled(c: DataFrame) -> DataFrame:
    """label 1 or 0 where format and context can tell, else null."""
    n, on = F.col("n_digits"), lambda name: F.col(name) == 1
    checked = on("luhn") | on("octets")  # formats of base kinds, which say nothing about the others
    number = F.when(on("date"), 0.0).when(on("national") | (on("has_plus") & n.between(9, 15)), 1.0).when(checked, None)
    number = number.when(on("ctx_number") & n.between(7, 15) & ~F.col("value").rlike("[0-9]\\.[0-9]{1,2}$"), 1.0).when(on("amount"), 0.0)
    contact = F.when(~on("domain"), 0.0).when(~on("spaced") | on("ctx_mail"), 1.0)
    secret = F.when(on("placeholder"), 0.0).when(on("hex") | on("mixed_secret") | (on("word_password") & ~F.col("before").rlike(r"\p{L}$")), 1.0)
    return c.withColumn("label", F.when(F.col("gen") == "number", number).when(F.col("gen") == "contact", contact).otherwise(secret))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def added_spans(found: DataFrame) -> DataFrame:
    """(k1, k2, added) from ``found`` (k1, k2, base, candidates): the candidates that the
    trees select, apart from base spans and from longer selected ones."""
    columns = ["k1", "k2", "base", "candidates", "own"]
    text = F.col("text")
    told = found.sparkSession.createDataFrame([(x,) for x in EXAMPLES], "text string").coalesce(1)
    told = told.select(F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), base_spans(text).alias("base"), candidates(text).alias("candidates"), F.lit(False).alias("own"))
    each = found.withColumn("own", F.lit(True)).select(*columns).unionByName(told).filter(F.size("candidates") > 0)
    each = each.select("k1", "k2", "base", "own", F.explode("candidates").alias("c")).select("k1", "k2", "base", "own", "c.*")
    free = ~F.exists("base", lambda b: (b["start"] < F.col("stop")) & (b["stop"] > F.col("start")))
    rows = cut_lineage(_labelled(_features(each)).withColumn("free", free).withColumn("draw", F.xxhash64("value", "before", "k1", "start")))
    # every labelled candidate counts; those that are alike are one row with their number
    alike = ["gen", "free", "label", "own", "fold", *FEATURES]
    counted = cut_lineage(rows.filter("label is not null").withColumn("fold", F.pmod("draw", F.lit(FOLDS))).groupBy(*alike).agg(F.count("*").cast("double").alias("n")))
    # the weight of a generator's label, and whether it may be added, is bounded
    group = ["gen", "label", "free", "own"]
    share = F.when(F.col("own"), F.least(F.lit(1.0), F.lit(GROUP_WEIGHT) / F.sum("n"))).otherwise(1.0)
    shares = F.broadcast(counted.groupBy(*group).agg(share.alias("share")))  # at most 24 rows
    weighed = cut_lineage(counted.join(shares, group).withColumn("weight", F.col("n") * F.col("share")))
    bins = max(32, isqrt(weighed.count()) + 1)  # Spark samples rows for the borders of bins from bins squared rows on
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=10, maxDepth=4, seed=7, labelCol="label", weightCol="weight", maxBins=bins)
    fit = lambda df: trees.fit(assembler.transform(df).select("features", "label", "weight"))
    score = lambda model, df: model.transform(assembler.transform(df)).withColumn("p", vector_to_array("probability")[1])
    # for each generator the lowest threshold, in hundredths, from which the precision of the held-out scores holds
    held = reduce(DataFrame.unionByName, [score(fit(weighed.filter(F.col("fold") != k)), weighed.filter((F.col("fold") == k) & F.col("free"))).select("gen", "p", "n", "label") for k in range(FOLDS)])
    steps = held.groupBy("gen", F.floor(F.col("p") * 100).alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hit")).orderBy("gen", F.desc("step")).collect()
    enough = F.lit(False)
    for gen in GENERATORS:
        threshold, n, hit = 101, 0.0, 0.0
        for s in (x for x in steps if x["gen"] == gen):  # at most 101 rows
            n, hit = n + s["n"], hit + s["hit"]
            if hit >= PRECISION * n:
                threshold = s["step"]
        enough = enough | ((F.col("gen") == gen) & (F.col("p") * 100 >= threshold))
    chosen = score(fit(weighed), rows.filter("own and free")).filter(enough)
    spans = chosen.groupBy("k1", "k2").agg(F.collect_set(F.struct("gen", "start", "stop")).alias("all"))

    def inner(a: Column, b: Column) -> Column:
        longer = (b["stop"] - b["start"] > a["stop"] - a["start"]) | ((b["stop"] - b["start"] == a["stop"] - a["start"]) & (b["gen"] < a["gen"]))
        return _overlap(a, b) & longer

    return spans.select("k1", "k2", F.filter("all", lambda a: ~F.exists("all", lambda b: inner(a, b))).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, base, added) of every row of ``docs`` (doc_id, text); k1 and k2
    are a key of id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2"), base_spans(text).alias("base"), candidates(text).alias("candidates"))
    found = cut_lineage(rows)
    added = bounded(cut_lineage(added_spans(found.dropDuplicates(["k1", "k2"]))))
    return found.drop("candidates").join(added, ["k1", "k2"], "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<gen:string,start:int,stop:int>>")))


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans, one row a document."""
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda name, s: F.concat_ws(":", name, s["start"].cast("string"), s["stop"].cast("string"))
    base = F.transform(F.array_sort("base"), lambda s: told(F.get(names, s["kind"]), s))
    extra = F.transform(F.array_sort("added"), lambda s: told(s["gen"], s))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, extra), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with each span (overlapping ones merged) replaced by its
    kind in brackets; ``n_chars``, where there is one, is the new length."""
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.upper(F.get(names, s["kind"])).alias("kind"))), F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.upper(s["gen"]).alias("kind"))))
    hit = find(docs).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.array_sort(spans).alias("_spans")).filter(F.size("_spans") > 0).dropDuplicates(["_k1", "_k2"])
    hit = cut_lineage(hit)
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    same = (F.xxhash64(doc_id, text) == F.col("_k1")) & (F.xxhash64(text, F.lit(1), doc_id) == F.col("_k2"))
    both = docs.join(bounded(hit), same, "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, F.length(docs["text"]))))
    new = F.when(F.col("_spans").isNull(), docs["text"]).otherwise(done)
    columns = {c: docs[c] for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_spans").isNull(), docs["n_chars"]).otherwise(F.length(new))
    return both.select(*(x.alias(c) for c, x in columns.items()))
