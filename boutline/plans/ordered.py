"""Ordered computation without a task that holds a whole group.

A window partitioned by a hot key sorts that key in one task. These helpers
split the order into coarse slots (day, id range, score range): slot totals are
map-side combined, prefix sums run over the small slot table, and rows are
windowed inside one slot only. ``levels`` are order-preserving coarse columns,
coarsest first; the last may be fine enough to bound the rows of one slot.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.session import cut_lineage

# Rows of one key above which its windows are split over several tasks.
HOT_ROWS = 5_000_000
# Rows of one block of a split key when fixed-length frames are evaluated.
BLOCK_ROWS = 1_000_000
# Rows that a task of plain windows gets, unless a key has more.
TASK_ROWS = 250_000
# Rows of a slot of values from which on the next level splits it.
SLOT_ROWS = 100_000
# Width of the id range used as the second slot level.
ID_CHUNK = 1 << 20

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}

# Slot of rows whose order value is null: before all others, as nulls sort. With it
# the slots are never null, so no null filter tells the branches of a plan apart and
# the slot aggregate is computed once and reused.
_FIRST_VALUE = {"date": "0001-01-01", "string": "", "int": -(1 << 31), "bigint": -(1 << 62)}

# Mantissa steps of one value level.
_STEPS = 1 << 16


def _join(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def time_levels(df: DataFrame, time: str, row: str, chunk: int = ID_CHUNK) -> list[Column]:
    """Slots for an order by (time, numeric row id). Each level grows with the order
    within the levels before it: a range of ids only counts among rows of one time,
    which is a day for dates and an exact moment for timestamps."""
    ids = F.floor(F.col(row) / chunk)
    if dict(df.dtypes)[time] == "date":
        return [F.col(time), ids]
    if dict(df.dtypes)[time] == "string":
        return [F.substring(time, 1, 10), F.col(time), ids]
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return [F.floor(at / 86_400_000_000), F.floor(at / 1_000_000), at, ids]


def value_levels(value: str) -> list[Column]:
    """Slots for an order by a double: its octave, then two times 16 bits of its
    mantissa, all with its sign, so each level grows with the value within the ones
    before. Dividing by a power of two is exact; a slot holds at most 2**21 values,
    however narrow the range they come from."""
    v = F.col(value).cast("double")
    size, sign = F.abs(v), F.when(F.isnan(v), 1.0).otherwise(F.signum(v))
    finite = (size > 0) & (size < float("inf"))
    octave = F.when(finite, F.greatest(F.floor(F.log2(size)), F.lit(-1074)))
    mantissa = F.when(finite, size / F.pow(F.lit(2.0), octave)).otherwise(1.0) * _STEPS
    rest = (mantissa - F.floor(mantissa)) * _STEPS
    first = F.when(F.isnan(v), 6000).when(v == float("inf"), 5000).when(v == float("-inf"), -5000).when(v == 0, 0).otherwise(sign * (octave + 1200)).cast("bigint")
    return [first, (sign * F.floor(mantissa)).cast("bigint"), (sign * F.floor(rest)).cast("bigint")]


def value_slots(df: DataFrame, keys: list[str], value: str, most: int = SLOT_ROWS) -> list[Column]:
    """The first of :func:`value_levels`, as many as it takes until no slot of a key has
    more than ``most`` rows: the last one alone makes almost as many slots as there are
    values. Asked by one aggregate; best called on a table that is written."""
    levels = value_levels(value)
    lv = [f"__l{i}" for i in range(2)]
    fine = df.select(*keys, *[c.alias(n) for n, c in zip(lv, levels)]).groupBy(*keys, *lv).count()
    coarse = fine.groupBy(*keys, lv[0]).agg(F.max("count").alias("two"), F.sum("count").alias("one"))
    one, two = coarse.agg(F.max("one"), F.max("two")).first()
    return levels[:1] if (one or 0) <= most else levels[:2] if two <= most else levels


def _slot_prefix(slots: DataFrame, keys: list[str], levels: list[str], measures, descending: bool) -> DataFrame:
    """Exclusive prefix of each measure over the slots of each key."""
    first = F.col(levels[0]).desc() if descending else F.col(levels[0]).asc()
    w = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    if len(levels) == 1:
        return slots.select(
            *keys, levels[0], *[_AGG[k](n).over(w).alias(f"__o_{n}") for n, k in measures.items()]
        )
    outer = (
        slots.groupBy(*keys, levels[0])
        .agg(*[_AGG[k](n).alias(n) for n, k in measures.items()])
        .select(*keys, levels[0], *[_AGG[k](n).over(w).alias(f"__p_{n}") for n, k in measures.items()])
    )
    inner = _slot_prefix(slots, keys + levels[:1], levels[1:], measures, descending)
    return inner.join(outer, keys + levels[:1]).select(
        *keys, *levels, *[_join(k, F.col(f"__o_{n}"), F.col(f"__p_{n}")).alias(f"__o_{n}") for n, k in measures.items()]
    )


def running(
    df: DataFrame,
    keys: list[str],
    levels: list[Column],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    descending: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds, per row, each measure over the rows strictly before it in the key's
    order (after it, when ``descending``). Sums start at 0, max/min at null.
    Keys must not be null. One shuffle of the rows, on (keys, slot). ``source`` may
    give the same rows before other steps, for a shorter way to the slot totals."""
    lv = [f"__l{i}" for i in range(len(levels))]

    def prepared(d):
        d = d.withColumns({**dict(zip(lv, levels)), **{f"__m_{n}": c for n, (_, c) in measures.items()}})
        types = dict(d.dtypes)
        return d.withColumns({c: F.coalesce(c, F.lit(_FIRST_VALUE[types[c]]).cast(types[c])) for c in lv})

    src = prepared(df)
    kinds = {n: k for n, (k, _) in measures.items()}
    slots = (src if source is None else prepared(source)).groupBy(*keys, *lv).agg(*[_AGG[k](f"__m_{n}").alias(n) for n, k in kinds.items()])
    offs = _slot_prefix(slots, keys, lv, kinds, descending)
    ordering = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    w = Window.partitionBy(*keys, *lv).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    joined = src.join(offs, keys + lv)
    return joined.select(
        *df.columns, *[_join(k, F.col(f"__o_{n}"), _AGG[k](f"__m_{n}").over(w)).alias(n) for n, k in kinds.items()]
    )


def ranked(df: DataFrame, keys: list[str], levels: list[Column], order: list[str], name: str = "_rank", source: DataFrame | None = None) -> DataFrame:
    """0-based position of each row in its key's order (of all rows if no keys)."""
    return running(df, keys, levels, order, {name: ("sum", F.lit(1))}, source=source).withColumn(name, F.col(name).cast("long"))


def border_rows(df: DataFrame, keys: list[str], levels: list[Column], order: list[str], places: dict[str, Column]) -> DataFrame:
    """(keys..., _n, <place>...): of each key its rows, and for each place (a 0-based position
    as a column over ``_n``) the order's values of the row there, null past the end. Rows
    are before a place if their order's values are smaller, so cuts by position need no rank
    of every row: they are counted by slot, and only the slots that hold a place are ordered.
    Keys must not be null and come with few places: one row a key, written."""
    lv = [f"__l{i}" for i in range(len(levels))]
    src = df.select(*keys, F.struct(*order).alias("__x"), *[c.alias(n) for n, c in zip(lv, levels)])
    types = dict(src.dtypes)
    src = src.withColumns({c: F.coalesce(c, F.lit(_FIRST_VALUE[types[c]]).cast(types[c])) for c in lv})
    slots = cut_lineage(src.groupBy(*keys, *lv).agg(F.count("*").alias("__c")))
    totals = slots.groupBy(*keys).agg(F.sum("__c").alias("_n"))
    at = with_totals(slots.join(_slot_prefix(slots, keys, lv, {"__c": "sum"}, False), [*keys, *lv]), totals, keys)
    first = F.coalesce("__o___c", F.lit(0))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), (p - first).alias("k")) for n, p in places.items()])
    held = at.withColumn("__w", F.filter(wanted, lambda w: (w["k"] >= 0) & (w["k"] < F.col("__c")))).filter(F.size("__w") > 0).select(*keys, *lv, "__w")
    w = Window.partitionBy(*keys, *lv).orderBy("__x")
    near = src.join(F.broadcast(held), [*keys, *lv]).withColumn("__k", F.row_number().over(w) - 1)
    found = near.select(*keys, "__x", F.explode(F.filter("__w", lambda w: w["k"] == F.col("__k"))).alias("__w"))
    rows = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__w.name") == n, F.col("__x"))).alias(n) for n in places])
    return cut_lineage(totals.join(rows, keys, "left") if keys else with_totals(rows, totals, []))


def with_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The totals of each row's key as columns. Without keys they are one row and
    come as a scalar: a join on a constant would be planned as a cross join."""
    if keys:
        return df.join(totals, keys)
    out = df.withColumn("__tot", totals.select(F.struct("*")).scalar())
    return out.withColumns({c: F.col(f"__tot.{c}") for c in totals.columns}).drop("__tot")


@dataclass(frozen=True)
class Past:
    """What to compute over the earlier rows of ``keys``.

    ``totals``: name -> (kind, column) over all earlier rows.
    ``late``: the same, evaluated after ``rank`` exists and free to use it.
    ``frames``: name -> (function, column, k) over the previous k rows.
    """

    keys: list[str]
    rank: str
    totals: dict = field(default_factory=dict)
    late: dict = field(default_factory=dict)
    frames: dict = field(default_factory=dict)


def _past_in_one_task(df: DataFrame, past: Past, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*past.keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def total(kind, col):
        out = _AGG[kind](col).over(before)
        return F.coalesce(out, F.lit(0)) if kind == "sum" else out

    out = df.withColumns(
        {
            past.rank: F.row_number().over(w).cast("long") - 1,
            **{n: total(k, c) for n, (k, c) in past.totals.items()},
            **{n: fn(c).over(w.rowsBetween(-k, -1)) for n, (fn, c, k) in past.frames.items()},
        }
    )
    return out.withColumns({n: total(k, c) for n, (k, c) in past.late.items()}) if past.late else out


def _past_split(df: DataFrame, past: Past, levels, order: list[str], block_rows: int, source: DataFrame) -> DataFrame:
    out = running(df, past.keys, levels, order, {past.rank: ("sum", F.lit(1)), **past.totals}, source=source)
    out = out.withColumn(past.rank, F.col(past.rank).cast("long"))
    if past.late:
        out = running(out, past.keys, levels, order, past.late)
    if past.frames:
        reach = max(k for _, _, k in past.frames.values())
        at = F.col(past.rank)
        # the last rows of a block are copied to the next one, where they only feed frames
        home = F.floor(at / block_rows)
        spread = out.withColumn(
            "__b",
            F.explode(
                F.when(at % block_rows >= block_rows - reach, F.array(home, home + 1)).otherwise(F.array(home))
            ),
        )
        w = Window.partitionBy(*past.keys, "__b").orderBy(past.rank)
        spread = spread.withColumns({n: fn(c).over(w.rowsBetween(-k, -1)) for n, (fn, c, k) in past.frames.items()})
        out = spread.filter(F.col("__b") == home).drop("__b")
    return out


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None if there are none."""
    if hot_rows is None:
        return None
    hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)
    return None if hot.isEmpty() else hot


def _dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as its ``rows`` ask for: the sorts and
    aggregates of a task keep its rows in memory, and few large tasks may not have it."""
    tasks = -(-rows // TASK_ROWS)
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > few else df


def history(
    df: DataFrame,
    base: list[str],
    pasts: list[Past],
    order: list[str],
    levels: list[Column],
    hot_rows: int | None = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All ``pasts`` of every row; their keys all start with ``base``.

    Keys of at most ``hot_rows`` rows share one shuffle on ``base``, over tasks of about
    ``TASK_ROWS`` rows, and plain windows. Hotter keys (at most rows / hot_rows of them, so the broadcast list
    is bounded) are split by slot and block. Whether there are any is asked once,
    by a count per key that reads the key columns only; ``hot_rows=None`` states
    that none is. Both ways give the same rows.
    """
    for p in pasts:
        if p.frames and max(k for _, _, k in p.frames.values()) > block_rows:
            raise ValueError("a frame is longer than a block")
    if hot_rows is None:
        return reduce(lambda d, p: _past_in_one_task(d, p, order), pasts, df)
    sizes = df.groupBy(*base).count()
    most, rows = sizes.agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= hot_rows:
        return reduce(lambda d, p: _past_in_one_task(d, p, order), pasts, _dealt(df, base, rows or 0))
    hot = F.broadcast(sizes.filter(F.col("count") > hot_rows).select(*base))
    cold_rows = _dealt(df.join(hot, base, "left_anti").select(*df.columns), base, rows)
    hot_part = df.join(hot, base, "left_semi").select(*df.columns)
    cold_out = reduce(lambda d, p: _past_in_one_task(d, p, order), pasts, cold_rows)

    def hot_way(d, p):
        # a finer key, as (entity, patch), may be small enough for plain windows
        if p.keys != base and hot_keys(hot_part, p.keys, hot_rows) is None:
            return _past_in_one_task(d, p, order)
        return _past_split(d, p, levels, order, block_rows, hot_part)

    hot_out = reduce(hot_way, pasts, hot_part)
    return cold_out.unionByName(hot_out.select(*cold_out.columns))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles, one column per name, one row per key.

    Values are counted first, so equal values meet map-side; the rank search
    runs over slots of distinct values, never over one group in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    pos = with_totals(running(counts, keys, value_levels(value), [value], {"__before": ("sum", F.col("__n"))}), total, keys)

    def at(rank):
        return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        want = F.lit(float(p)) * (F.col("__t") - 1)
        aggs += [at(F.floor(want)).alias(f"{name}_lo"), at(F.ceil(want)).alias(f"{name}_hi")]
    got = pos.groupBy(*keys).agg(F.first("__t").alias("__t"), *aggs)

    def mix(name, p):
        want = F.lit(float(p)) * (F.col("__t") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (lo + (hi - lo) * (want - F.floor(want))).alias(name)

    return got.select(*keys, *[mix(n, p) for n, p in probs.items()])
