"""Chat formatting by prefix-target expansion.

A turn is written as ``<turn role>``, a line end, its text, ``</turn>`` and a line end. In
texts and roles a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles also ``>``
and line ends, ``\\g`` and ``\\n``), so no text can hold a marker and all are read back.

Every assistant turn is an example of its own: its prompt is all that stands before its
text in the formatted conversation, and its text alone is trainable. :func:`expand` writes
both out, a row an example. The examples of a conversation grow with the square of its
turns, as the method has it; a task makes them one after the other and holds one beside the
conversation. :func:`report` reads digests back from these rows.

:func:`placed` gives each turn once with its offsets (code points). These are running sums
in two levels (runs of 1,024 turn numbers, then turns), so a conversation with a large share
of all turns is spread over tasks up to there. DataFrame functions only.

Defined cases: a null text or role is empty; turns are ordered by turn (null last), then
role and text; repeated rows are turns each; rows with a null conv_id are one conversation;
a conversation without an assistant turn has no example; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RUN = 1024
CLOSE = "</turn>\n"


def _swapped(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_TEXT = [("\\", "\\b"), ("<", "\\l")]
_ROLE = [*_TEXT, (">", "\\g"), ("\n", "\\n")]


def escaped(text: Column, role: bool = False) -> Column:
    return _swapped(F.coalesce(text, F.lit("")), _ROLE if role else _TEXT)


def unescaped(text: Column, role: bool = False) -> Column:
    """The inverse: the backslash, escaped first, is restored last."""
    return _swapped(text, [(b, a) for a, b in reversed(_ROLE if role else _TEXT)])


def placed(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, start and stop of its ``segment`` in the formatted
    conversation, and for an assistant turn loss_start and loss_stop of its text (else
    null). A segment starts where the turns before it end."""
    head = F.concat(F.lit("<turn "), escaped(F.col("role"), True), F.lit(">\n"))
    t = conversations.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / RUN).alias("run"), F.length(head).cast("long").alias("head"), F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("segment"))
    t = t.withColumn("size", F.length("segment").cast("long"))
    up_to = (W.unboundedPreceding, W.currentRow)
    inside = W.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(*up_to)
    runs = t.groupBy("conv_id", "run").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_last()).rowsBetween(*up_to)) - F.col("n")
    runs = runs.select(F.col("conv_id").alias("_conv"), F.col("run").alias("_run"), before.alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("run").eqNullSafe(F.col("_run"))
    placed = t.withColumn("within", F.sum("size").over(inside)).join(runs, same).withColumn("stop", F.col("before") + F.col("within"))
    start = F.col("stop") - F.col("size")
    reply = F.col("role") == "assistant"
    loss_start, loss_stop = start + F.col("head"), F.col("stop") - len(CLOSE)
    return placed.select("conv_id", start.alias("start"), "stop", "segment", F.when(reply, loss_start).alias("loss_start"), F.when(reply, loss_stop).alias("loss_stop"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, text, spans) from rows of :func:`placed`: the formatted conversation in one
    text and the spans of its replies in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "segment", "loss_start", "loss_stop")))
    c = turns.groupBy("conv_id").agg(ordered.alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_stop"].alias("stop")))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"), spans.alias("spans"))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, prompt, reply, last), texts still escaped: a row for each assistant
    turn, numbered from 0 in order, with all that stands before its text and the text itself;
    and for each conversation a row with a null example and reply, whose prompt is the rest
    after its last reply (everything, if it has none)."""
    c = formatted(placed(conversations)).withColumn("n", F.size("spans"))
    numbered = F.transform("spans", lambda s, i: F.struct(i.alias("example"), s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop")))
    done = F.coalesce(F.get("spans", F.col("n") - 1)["stop"].cast("int"), F.lit(0))
    rest = F.struct(F.lit(None).cast("int").alias("example"), done.alias("start"), F.length("text").alias("stop"))
    each = c.select("conv_id", "text", "n", F.explode(F.concat(numbered, F.array(rest))).alias("x"))
    own, at = F.col("x.example").isNotNull(), F.col("x.start")
    target = F.substring(F.col("text"), at + 1, F.col("x.stop") - at)
    prompt = F.when(own, F.substring(F.col("text"), F.lit(1), at)).otherwise(target)
    return each.select("conv_id", "x.example", prompt.alias("prompt"), F.when(own, target).alias("reply"), F.coalesce(F.col("x.example") == F.col("n") - 1, F.lit(False)).alias("last"))


def examples(expanded: DataFrame) -> DataFrame:
    """The rows of :func:`expand` that are examples."""
    return expanded.filter("example IS NOT NULL")


def report(expanded: DataFrame) -> DataFrame:
    """Counts and digests of a conversation, read back from rows of :func:`expand`: turns by
    their markers in the last example and the rest, trainable text from all replies."""
    pieces = F.filter(F.split("text", F.lit(CLOSE), -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">\n", 1)
        own = F.substring(p, F.length(head) + 3, F.length(p))
        return F.concat(unescaped(F.substring(head, F.lit(7), F.length(head)), True), F.lit("\n"), unescaped(own), F.lit("\n"))

    rows = expanded.select(
        "conv_id", F.when(F.col("example").isNotNull(), F.struct("example", "reply")).alias("x"),
        F.when(F.col("last"), F.concat("prompt", "reply")).alias("head"), F.when(F.col("example").isNull(), F.col("prompt")).alias("rest"),
    )  # of all prompts only the last goes on
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.concat(F.coalesce(F.max("head"), F.lit("")), F.max("rest")).alias("text"))
    loss = F.array_join(F.transform("xs", lambda x: unescaped(x["reply"])), "")
    r = per.select("conv_id", "text", F.transform(pieces, turn).alias("turns"), loss.alias("loss"))
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
