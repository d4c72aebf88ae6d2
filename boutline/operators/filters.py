"""Projections, filters and value policies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.scalar import patch_number, patch_part
from boutline.roles import MATCH, NO_BAN, UNKNOWN, Roles

# Old league names and the name they are known by now.
LEAGUE_NAMES = {"NA LCS": "LCS", "EU LCS": "LEC", "Worlds": "WLDs"}
# Spellings of positions.
POSITION_NAMES = {
    "top": "top", "jungle": "jng", "jng": "jng", "jgl": "jng", "mid": "mid", "middle": "mid",
    "bot": "bot", "adc": "bot", "carry": "bot", "sup": "sup", "support": "sup", "supp": "sup",
}
# Name fragments of columns known only after a game.
LEAK_FRAGMENTS = ("kills", "deaths", "assists", "gold", "damage", "cs", "vision")
# Columns kept from the raw player files.
RAW_COLUMNS = (
    "gameid", "league", "date", "patch", "split", "playoffs", "year", "game", "teamname", "side", "result",
    "champion", "position", "playername", "ban1", "ban2", "ban3", "ban4", "ban5", "gamelength",
)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def project_known(df: DataFrame, wanted: list[str] | tuple[str, ...], time: str | None = None, year: str = "year") -> DataFrame:
    """Keep the wanted columns that exist; derive the year from the date if absent."""
    out = df.select(*[c for c in wanted if c in df.columns])
    if time and time in out.columns and year not in out.columns:
        out = out.withColumn(year, F.year(time))
    return out


def in_leagues(df: DataFrame, leagues: list[str], roles: Roles = MATCH) -> DataFrame:
    return df.filter(F.col(roles.league).isin(leagues))


def canonical_league(df: DataFrame, roles: Roles = MATCH, names: dict[str, str] = LEAGUE_NAMES) -> DataFrame:
    """Apply after the league filter, so that the filter stays on the raw column."""
    return df.withColumn(roles.league, F.coalesce(F.element_at(literal_map(names), F.col(roles.league)), F.col(roles.league)))


def drop_leak_columns(df: DataFrame, fragments=LEAK_FRAGMENTS, keep: tuple[str, ...] = ()) -> DataFrame:
    bad = [c for c in df.columns if c not in keep and any(f in c.lower() for f in fragments)]
    return df.drop(*bad)


def exclude_entities(df: DataFrame, substrings: list[str], exact: list[str], roles: Roles = MATCH) -> DataFrame:
    """Drop entities by case-insensitive substring and by exact name; null names
    pass both, as they match nothing."""
    name = F.col(roles.entity)
    keep = F.lit(True)
    if substrings:
        keep = ~F.coalesce(F.lower(name).rlike("|".join(re.escape(s.lower()) for s in substrings)), F.lit(False))
    if exact:
        keep = keep & ~F.coalesce(name.isin(exact), F.lit(False))
    return df.filter(keep)


def exclude_listed(df: DataFrame, listed: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """The exact list as a table, for lists too long for a literal."""
    return df.join(listed, roles.entity, "left_anti")


def min_games(df: DataFrame, n: int = 10, roles: Roles = MATCH) -> DataFrame:
    """Rows of entities with at least n rows. A counted key table and a semi join,
    so that a hot entity is never sorted into one task."""
    kept = df.groupBy(roles.entity).count().filter(F.col("count") >= n).select(roles.entity)
    return df.join(kept, roles.entity, "left_semi")


def valid_rows(df: DataFrame, result: str, time: str, required: list[str]) -> DataFrame:
    """Required columns present, result coerced to 0/1, date parses."""
    out = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required]))
    r = F.col(result).try_cast("double")
    t = F.col(time)
    if dict(df.dtypes)[time] == "string":
        t = F.try_to_timestamp(t)
    return out.withColumns({result: r.cast("int"), time: t}).filter(r.isin(0.0, 1.0) & t.isNotNull())


# Defaults of numeric columns.
NUMERIC_DEFAULTS = {"playoffs": 0.0, "year": 2023.0, "game_length": 30.0}


def fill_missing(df: DataFrame, roles: Roles = MATCH, numerics: dict[str, float] = NUMERIC_DEFAULTS) -> DataFrame:
    """Text 'nan'/'None'/'' or null becomes a sentinel; numbers become defaults."""
    text = [*roles.champions, *roles.players, roles.patch, roles.split, roles.league, roles.entity]
    new = {}
    for c in [c for c in text if c in df.columns]:
        new[c] = F.when(F.col(c).isNull() | F.col(c).isin("nan", "None", ""), UNKNOWN).otherwise(F.col(c))
    for c in [c for c in roles.bans if c in df.columns]:
        new[c] = F.when(F.col(c).isNull() | F.col(c).isin("nan", "None", ""), NO_BAN).otherwise(F.col(c))
    for c, v in numerics.items():
        if c in df.columns:
            new[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(v))
    return df.withColumns(new)


def similar_names(names: DataFrame, targets: DataFrame, name: str, target: str, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, target) where one contains the other, ignoring case, or where a
    keyword of the target occurs in the name.

    Both are distinct short name lists. Containment is found by equality of
    substrings: every substring of the longer name whose length some shorter name
    has is looked up, so no pair is compared that does not match.
    """
    def lowered(df, col, out):
        return df.select(F.col(col), F.lower(col).alias(out)).filter(F.length(out) > 0).distinct()

    def pieces(df, col, low):
        at = F.explode(F.sequence(F.lit(1), F.length(low))).alias("__i")
        starts = df.select(col, low, at)
        rest = F.explode(F.sequence(F.lit(1), F.length(low) - F.col("__i") + 1)).alias("__n")
        return starts.select(col, low, "__i", rest).select(col, F.substring(F.col(low), F.col("__i"), F.col("__n")).alias("__piece")).distinct()

    a, b = lowered(names, name, "__a"), lowered(targets, target, "__b")
    within = pieces(b, target, "__b").join(a, F.col("__piece") == F.col("__a")).select(name, target)
    around = pieces(a, name, "__a").join(b, F.col("__piece") == F.col("__b")).select(name, target)
    out = within.unionByName(around)
    if keywords:
        rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k.lower()).alias("k")) for t, ks in keywords.items() for k in ks])
        hit = F.explode(F.filter(rows, lambda x: F.contains(F.col("__a"), x["k"])))
        out = out.unionByName(a.select(name, hit.alias("x")).select(name, F.col("x.t").alias(target)))
    return out.distinct()


def normal_position(df: DataFrame, position: str = "position", names: dict[str, str] = POSITION_NAMES) -> DataFrame:
    """Canonical position; rows with an unknown one are dropped."""
    return df.withColumn(position, F.element_at(literal_map(names), F.lower(F.trim(position)))).filter(F.col(position).isNotNull())


def rolling_window(df: DataFrame, reference: Column, months: int = 12, roles: Roles = MATCH) -> DataFrame:
    """Rows of the last ``months`` 30-day months before ``reference``."""
    return df.filter(F.col(roles.time) >= F.date_sub(reference, 30 * months))


def patch_columns(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    return df.withColumns(
        {
            "patch_number": patch_number(roles.patch),
            "patch_major": patch_part(roles.patch, 0),
            "patch_minor": patch_part(roles.patch, 1),
        }
    )


def fill_context(drafts: DataFrame, matches: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Placeholder context of drafts: the latest known patch, year from the patch,
    no playoffs, league and split of the entity's latest row."""
    latest = matches.select(F.max_by(roles.patch, F.struct(roles.time, roles.row))).scalar()
    last = matches.groupBy(roles.entity).agg(
        F.max_by(F.struct(F.col(roles.league).alias("league"), F.col(roles.split).alias("split")), F.struct(roles.time, roles.row)).alias("__x")
    )
    patch = F.coalesce(F.col(roles.patch), latest)
    out = drafts.join(last, roles.entity, "left")
    return out.select(
        *[c for c in drafts.columns if c not in (roles.patch,)],
        patch.alias(roles.patch),
        (patch_part(patch, 0) + 2010).alias("year"),
        F.lit(0).alias("playoffs"),
        F.coalesce(F.col("__x.league"), F.lit(UNKNOWN)).alias("league"),
        F.coalesce(F.col("__x.split"), F.lit(UNKNOWN)).alias("split"),
    )
