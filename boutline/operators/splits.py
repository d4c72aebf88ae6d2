"""Train/validation/test tags, folds and sample weights.

Ranks over all rows, or over a whole year, come from ``plans.ordered``: no task
ever sorts more than one slot of the order. Random orders are hashes of the row
id, the same in every engine and after every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.scalar import clip, patch_number
from boutline.plans.ordered import HOT_ROWS, Past, border_rows, history, ranked, time_levels
from boutline.roles import MATCH, Roles

# Ratio presets (train, validation, test).
PRESETS = {"70_15_15": (0.70, 0.15, 0.15), "60_20_20": (0.60, 0.20, 0.20), "70_20_10": (0.70, 0.20, 0.10)}


def tag(rank: Column, n: Column, train: float, val: float) -> Column:
    return (
        F.when(rank < F.floor(n * F.lit(train)), "train").when(rank < F.floor(n * F.lit(train + val)), "val").otherwise("test")
    )


def time_rank(df: DataFrame, keys: list[str], roles: Roles = MATCH, name: str = "_rank", source: DataFrame | None = None) -> DataFrame:
    return ranked(df, keys, time_levels(df, roles.time, roles.row), [roles.time, roles.row], name, source)


def temporal_split(df: DataFrame, train: float = 0.7, val: float = 0.15, roles: Roles = MATCH) -> DataFrame:
    """First part of the whole order, next part, rest."""
    n = df.agg(F.count("*")).scalar()
    return time_rank(df, [], roles).withColumn("split", tag(F.col("_rank"), n, train, val))


def _tagged(df: DataFrame, keys: list[str], levels: list[Column], order: list[str], cuts: dict[str, tuple], min_rows: int) -> DataFrame:
    """``df`` with a split column for each of ``cuts`` (name -> shares of train, validation and more): a row's order
    values are compared with those of the rows at the cuts, so no row is moved."""
    places = {f"{name}-{i}": F.floor(F.col("_n") * F.lit(sum(r[: i + 1]))) for name, r in cuts.items() for i in range(2)}
    b = border_rows(df, keys, levels, order, places).filter(F.col("_n") >= min_rows)
    if keys:
        out = df.join(F.broadcast(b), keys, "left")  # a row a key: as short as the calendar
    else:  # one row: its values are constants, so that no reader of the tags asks for them again
        row, types = b.first(), dict(b.select(*[f"`{p}`.{o}" for p in list(places)[:1] for o in order]).dtypes)
        border = lambda p: F.struct(*[F.lit(row[p][o]).cast(types[o]).alias(o) for o in order]) if row and row[p] else F.lit(None)
        out = df.withColumns({"_n": F.lit(row["_n"] if row else None), **{p: border(p) for p in places}})
    before = lambda place: F.col(f"`{place}`").isNull() | (F.struct(*order) < F.col(f"`{place}`"))
    tag = lambda name: F.when(F.col("_n").isNotNull(), F.when(before(f"{name}-0"), "train").when(before(f"{name}-1"), "val").otherwise("test"))
    return out.select(*[f"`{c}`" for c in df.columns], *[tag(name).alias(name) for name in cuts])


def temporal_tags(df: DataFrame, cuts: dict[str, tuple], keys: list[str] | None = None, min_rows: int = 0, roles: Roles = MATCH) -> DataFrame:
    """The splits of :func:`temporal_split` (of :func:`stratified_temporal_split` with
    ``keys``) for several ratios, without ranks; null where a key has too few rows. Reads
    ``df`` a few times, so it should be written."""
    return _tagged(df, keys or [], time_levels(df, roles.time, roles.row), [roles.time, roles.row], cuts, min_rows)


def random_tags(df: DataFrame, cuts: dict[str, tuple], seed: str = "42", min_rows: int = 10, roles: Roles = MATCH) -> DataFrame:
    """The splits of :func:`stratified_random_split` likewise."""
    hashed = df.withColumn("_h", F.md5(_hash_text(seed, [roles.year], roles)))
    return _tagged(hashed, [roles.year], _hash_slots(), ["_h", roles.row], cuts, min_rows).drop("_h")


def _with_size(df: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Rows of groups of at least min_rows, with the group's size. The counted table
    has one row per year (and label): as short as the calendar, so it is broadcast
    and a year that holds a third of the rows is not shuffled to one task."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    return df.join(F.broadcast(size), keys)


def stratified_temporal_split(df: DataFrame, train: float = 0.7, val: float = 0.15, min_rows: int = 10, roles: Roles = MATCH) -> DataFrame:
    """The same cut within each year; years with too few rows are dropped."""
    d = time_rank(_with_size(df, [roles.year], min_rows), [roles.year], roles, source=df)
    return d.withColumn("split", tag(F.col("_rank"), F.col("_n"), train, val))


def _hash_text(seed: str, parts: list[str], roles: Roles) -> Column:
    return F.concat_ws("-", F.lit(seed), *[F.col(p).cast("string") for p in parts], F.col(roles.row).cast("string"))


def _hash_slots() -> list[Column]:
    return [F.substring("_h", 1, 2), F.substring("_h", 1, 4)]


def shuffled(df: DataFrame, keys: list[str], seed: str, parts: list[str], roles: Roles = MATCH, source: DataFrame | None = None) -> DataFrame:
    """Rank in the order of md5(seed-parts-row) within keys. The hash prefix is the
    slot, so slots are even whatever the data."""
    hashed = lambda d: d.withColumn("_h", F.md5(_hash_text(seed, parts, roles)))
    return ranked(hashed(df), keys, _hash_slots(), ["_h", roles.row], source=None if source is None else hashed(source)).drop("_h")


def stratified_random_split(df: DataFrame, train: float = 0.7, val: float = 0.15, seed: str = "42", by_label: bool = False, min_rows: int = 10, roles: Roles = MATCH) -> DataFrame:
    keys = [roles.year, roles.outcome] if by_label else [roles.year]
    d = shuffled(_with_size(df, keys, min_rows), keys, seed, [roles.year], roles, df)
    return d.withColumn("split", tag(F.col("_rank"), F.col("_n"), train, val))


def stratified_folds(df: DataFrame, k: int = 5, val: float = 0.2, seed: str = "cv", roles: Roles = MATCH) -> DataFrame:
    """Long (fold, row, role): per fold and year a validation block of the shuffled
    year at offset fold*floor(n/k) mod (n - v), the rest train."""
    d = shuffled(_with_size(df, [roles.year], k), [roles.year], seed, [roles.year], roles, df)
    n, r = F.col("_n"), F.col("_rank")
    v = F.greatest(F.floor(n * F.lit(val)), F.lit(1))
    out = d.select(roles.row, roles.year, "_n", "_rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    start = (F.col("fold") * F.floor(n / k)) % F.greatest(n - v, F.lit(1))
    return out.select("fold", roles.row, roles.year, F.when((r >= start) & (r < start + v), "val").otherwise("train").alias("role"))


# Fixed values: (train end, validation length) of the expanding windows.
OUTER_WINDOWS = tuple((e / 100, 0.15) for e in (30, 40, 50, 60, 70, 80))
INNER_WINDOWS = tuple((e / 100, 0.20) for e in (40, 50, 60, 70))


def expanding_folds(df: DataFrame, windows=OUTER_WINDOWS, roles: Roles = MATCH) -> DataFrame:
    """Long (fold, row, role): train up to a share of the order, validate on the
    next. Rows outside a fold are left out of it."""
    n = df.agg(F.count("*")).scalar()
    d = time_rank(df, [], roles).withColumn("_n", n)
    r = F.col("_rank")

    def role(i, e, v):
        end, stop = F.floor(F.col("_n") * F.lit(e)), F.floor(F.col("_n") * F.lit(min(e + v, 1.0)))
        return F.struct(F.lit(i).alias("fold"), F.when(r < end, "train").when(r < stop, "val").alias("role"))

    roles_of = F.array(*[role(i, e, v) for i, (e, v) in enumerate(windows)])
    return d.select(roles.row, F.explode(F.filter(roles_of, lambda x: x["role"].isNotNull())).alias("x")).select("x.fold", roles.row, "x.role")


def block_folds(df: DataFrame, k: int = 5, roles: Roles = MATCH) -> DataFrame:
    """k equal consecutive blocks of the order; the last takes the remainder."""
    n = df.agg(F.count("*")).scalar()
    return time_rank(df, [], roles).withColumn("fold", F.least(F.floor(F.col("_rank") / F.floor(n / k)), F.lit(k - 1)).cast("int"))


def temporal_samples(df: DataFrame, window: int = 10, step: int = 5, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per entity, windows of ``window`` rows starting every ``step`` rows, full
    ones only: mean outcome, size, first and last date.

    A window is read at its last row, as a frame of earlier rows, so it is the same
    machinery as any history.
    """
    y = F.col(roles.outcome)
    h = history(
        df.select(roles.entity, roles.row, roles.time, roles.outcome),
        [roles.entity],
        [
            Past(
                [roles.entity], "_rank",
                frames={"__s": (F.sum, y, window - 1), "__c": (F.count, y, window - 1), "__first": (F.min, F.col(roles.time), window - 1)},
            )
        ],
        [roles.time, roles.row], time_levels(df, roles.time, roles.row), hot_rows,
    )
    start = F.col("_rank") - (window - 1)
    return h.filter((start >= 0) & (start % step == 0)).select(
        roles.entity, (start / step).cast("long").alias("sample"),
        ((F.coalesce("__s", F.lit(0)) + y) / window).alias("mean_outcome"), (F.col("__c") + 1).alias("window_size"),
        F.coalesce("__first", roles.time).alias("first_date"), F.col(roles.time).alias("last_date"),
    )


def temporal_weight(days: Column, kind: str = "exponential", half_life: float = 180.0, max_days: Column | None = None) -> Column:
    """Weight by age in days, clipped to [0.1, 1]."""
    import math

    if kind == "exponential":
        w = F.exp(days * F.lit(-math.log(2) / half_life))
    elif kind == "linear":
        w = 1 - days / (max_days + 1)
    elif kind == "step":
        w = F.when(days < 180, 1.0).when(days < 365, 0.7).otherwise(0.4)
    else:
        raise ValueError(f"unknown decay {kind}")
    return clip(w, 0.1, 1.0)


def temporal_weights(df: DataFrame, kind: str = "exponential", half_life: float = 180.0, roles: Roles = MATCH, reference: Column | None = None) -> DataFrame:
    t = F.col(roles.time)
    ref = df.agg(F.max(roles.time)).scalar() if reference is None else reference
    oldest = df.agg(F.min(roles.time)).scalar()
    return df.withColumn("temporal_weight", temporal_weight(F.datediff(ref, t), kind, half_life, F.datediff(ref, oldest)))


def patch_weights(df: DataFrame, roles: Roles = MATCH, current: Column | None = None) -> DataFrame:
    """0.8 to the power of the version distance from the latest row's patch."""
    cur = df.agg(F.max_by(roles.patch, F.struct(roles.time, roles.row))).scalar() if current is None else current
    w = F.pow(F.lit(0.8), F.abs(patch_number(cur) - patch_number(roles.patch)).cast("double"))
    return df.withColumn("patch_weight", clip(w, 0.1, 1.0))


def combined_weights(df: DataFrame, time_share: float = 0.6, patch_share: float = 0.4, roles: Roles = MATCH) -> DataFrame:
    """Mix of both, scaled to sum to the number of rows. The scale is one scalar
    aggregate, not a window over all rows."""
    d = patch_weights(temporal_weights(df, roles=roles), roles)
    mix = F.col("temporal_weight") * time_share + F.col("patch_weight") * patch_share
    scale = d.agg(F.count("*") / F.sum(mix)).scalar()
    return d.withColumn("sample_weight", mix * scale)


def split_summary(df: DataFrame, measures: dict[str, str], keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.avg(c).alias(n) for n, c in measures.items()])


def first_last(df: DataFrame, n: int = 1000, roles: Roles = MATCH) -> DataFrame:
    """The first and the last n rows of the order, tagged: two top-k plans."""
    order = [F.col(roles.time), F.col(roles.row)]
    head = df.orderBy(*order).limit(n).withColumn("part", F.lit("first"))
    tail = df.orderBy(*[c.desc() for c in order]).limit(n).withColumn("part", F.lit("last"))
    return head.unionByName(tail)


def sample_rows(df: DataFrame, year: int, n: int, roles: Roles = MATCH) -> DataFrame:
    return df.filter(F.col(roles.year) == year).orderBy(roles.time, roles.row).limit(n)


def by_size(df: DataFrame, sizes: list[float], seed: str = "lc", roles: Roles = MATCH) -> DataFrame:
    """Nested random subsets for learning curves: each row once per size it is in,
    by the hash order of its id."""
    frac = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(roles.row).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: frac < s)))

