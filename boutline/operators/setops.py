"""Unions, mirroring, deduplication and the player-to-team pivot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.filters import POSITION_NAMES, literal_map
from boutline.roles import MATCH, NO_BAN, ROLE_PREFIX, UNKNOWN, Roles


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Concatenation aligned by name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mirror(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Every row and its mirror image (result and side swapped), in one scan."""
    side = F.col(roles.side)
    other = F.when(side == "Blue", "Red").when(side == "Red", "Blue").otherwise(side)
    both = F.array(
        F.struct(F.col(roles.outcome).alias("r"), side.alias("s"), F.lit(False).alias("a")),
        F.struct((1 - F.col(roles.outcome)).alias("r"), other.alias("s"), F.lit(True).alias("a")),
    )
    rest = [c for c in df.columns if c not in (roles.outcome, roles.side)]
    return df.select(*rest, F.explode(both).alias("__x")).select(
        *rest, F.col("__x.r").alias(roles.outcome), F.col("__x.s").alias(roles.side), F.col("__x.a").alias("is_augmented")
    )


def mirror_sizes(df: DataFrame, mirrored: DataFrame) -> DataFrame:
    """Original and augmented row counts and their ratio."""
    return (
        mirrored.agg(
            F.count_if(~F.col("is_augmented")).alias("original_rows"),
            F.count("*").alias("augmented_rows"),
        )
        .withColumn("ratio", F.col("augmented_rows") / F.col("original_rows"))
    )


def _keep(df: DataFrame, keys: list[str], rank: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*rank)).alias("__x"))
    return got.select(*keys, "__x.*")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union in which the new rows win, and the last of several new rows. The pick
    is an aggregate with map-side combine, so copies of one key meet early."""
    both = stored.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return _keep(both, keys, ["__src", *order], F.max_by).drop("__src")


def insert_only(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union in which stored rows, and the first of several, win."""
    both = stored.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return _keep(both, keys, ["__src", *order], F.min_by).drop("__src")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def new_games(new: DataFrame, stored: DataFrame, roles: Roles = MATCH) -> DataFrame:
    return new.join(stored.select(roles.game).distinct(), roles.game, "left_anti")


def two_sided_games(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Games that have both a Blue and a Red row: one pass instead of an intersect."""
    return (
        df.groupBy(roles.game)
        .agg(F.bool_or(F.col(roles.side) == "Blue").alias("b"), F.bool_or(F.col(roles.side) == "Red").alias("r"))
        .filter("b AND r")
        .select(roles.game)
    )


def team_rows_from_players(players: DataFrame, order: str, context: list[str], roles: Roles = MATCH, min_rows: int = 4, max_unknown: int = 2) -> DataFrame:
    """One row per (game, entity) out of player rows.

    Context of the first row, last champion and player of each position, groups
    of at least ``min_rows`` rows, at most ``max_unknown`` empty positions. Every
    aggregate is a first/last by ``order``: constant state per group.
    """
    have = set(players.columns)
    ctx = [c for c in context if c in have]
    bans = [b for b in roles.bans if b in have]
    ordered = F.col(order)
    aggs = [F.count("*").alias("__n"), F.min_by(F.struct(*ctx, *bans), ordered).alias("__ctx")]
    pos = F.lower(F.trim("position"))
    canon = F.element_at(literal_map(POSITION_NAMES), pos)
    src = players.withColumn("__pos", canon)
    for p in ROLE_PREFIX:
        at = F.when(F.col("__pos") == p, ordered)
        aggs += [
            F.max_by("champion", at).alias(f"{p}_champion"),
            F.max_by("playername", at).alias(f"{p}_player"),
        ]
    out = src.groupBy(roles.game, roles.entity).agg(*aggs).filter(F.col("__n") >= min_rows)
    filled = out.select(
        roles.game, roles.entity,
        *[F.col(f"__ctx.{c}").alias(c) for c in ctx if c not in (roles.game, roles.entity)],
        *[F.coalesce(F.col(f"__ctx.{b}"), F.lit(NO_BAN)).alias(b) for b in bans],
        *[F.coalesce(f"{p}_champion", F.lit(UNKNOWN)).alias(f"{p}_champion") for p in ROLE_PREFIX],
        *[F.coalesce(f"{p}_player", F.lit(UNKNOWN)).alias(f"{p}_player") for p in ROLE_PREFIX],
    )
    empty = reduce(lambda a, b: a + b, [(F.col(f"{p}_champion") == UNKNOWN).cast("int") for p in ROLE_PREFIX])
    return filled.filter(empty <= max_unknown)
