"""Keyed statistics of champions, entities, patches and matchups.

Every lookup is a flat DataFrame with one column per key level. Sizes depend on
the number of distinct names, not on rows: rows are aggregated (map-side first)
before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.scalar import meta_strength, ratio
from boutline.operators.form import ban_long, role_long
from boutline.roles import MATCH, ROLES, UNKNOWN, Roles

# Display labels of the five roles.
ROLE_LABELS = ("Top", "Jungle", "Mid", "ADC", "Support")
# Archetype names.
ARCHETYPES = ("HyperScaling", "BalancedScaling", "EarlyGame", "FlexPick", "Balanced")


def champion_characteristics(df: DataFrame, roles: Roles = MATCH, min_games: int = 5) -> DataFrame:
    """Per champion: games, wins, win_rate, flexibility (roles seen) and the
    alphabetically last role label. One aggregate; a flag per role instead of a
    distinct count."""
    long = role_long(df, roles, [roles.outcome])
    seen = [F.max((F.col("role") == r).cast("int")).alias(f"__r{i}") for i, r in enumerate(ROLES)]
    g = long.groupBy("champion").agg(F.count(roles.outcome).alias("games"), F.sum(roles.outcome).alias("wins"), *seen)
    labels = sorted(zip(ROLE_LABELS, range(5)), reverse=True)
    primary = F.coalesce(*[F.when(F.col(f"__r{i}") == 1, F.lit(lab)) for lab, i in labels])
    return (
        g.filter(F.col("games") >= min_games)
        .withColumns(
            {
                "win_rate": F.col("wins") / F.col("games"),
                "flexibility": sum((F.col(f"__r{i}") for i in range(1, 5)), F.col("__r0")),
                "primary_position": primary,
                "early_game_strength": F.lit(0.5),
                "late_game_strength": F.lit(0.5),
                "scaling_factor": F.lit(0.0),
            }
        )
        .drop(*[f"__r{i}" for i in range(5)])
    )


def archetype(early: Column, scaling: Column, flexibility: Column) -> Column:
    """Thresholds of +-0.3 on scaling, 0.3 on early strength, three roles."""
    return (
        F.when(scaling > 0.3, F.when(early < 0.3, "HyperScaling").otherwise("BalancedScaling"))
        .when(scaling < -0.3, "EarlyGame")
        .when(flexibility >= 3, "FlexPick")
        .otherwise("Balanced")
    )


def champion_archetypes(chars: DataFrame) -> DataFrame:
    return chars.select("champion", archetype(F.col("early_game_strength"), F.col("scaling_factor"), F.col("flexibility")).alias("archetype"))


def meta_indicators(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Per (patch, champion): games, wins, bans, rates, popularity, meta strength.
    Rates divide by twice the patch's team rows."""
    picks = role_long(df, roles, [roles.patch, roles.outcome]).groupBy(roles.patch, "champion").agg(
        F.count(roles.outcome).alias("games"), F.sum(roles.outcome).alias("wins")
    )
    bans = ban_long(df, roles, [roles.patch]).groupBy(roles.patch, "champion").agg(F.count("*").alias("bans"))
    total = df.groupBy(roles.patch).agg(F.count("*").alias("total_games"))
    m = picks.join(bans, [roles.patch, "champion"], "left").join(total, roles.patch, "left")
    den = F.col("total_games") * 2
    bans_n = F.coalesce("bans", F.lit(0))
    pick_rate, ban_rate = F.col("games") / den, bans_n / den
    wr = F.col("wins") / F.col("games")
    return m.select(
        roles.patch, "champion", "games", "wins", bans_n.alias("bans"), "total_games", wr.alias("win_rate"),
        pick_rate.alias("pick_rate"), ban_rate.alias("ban_rate"), (pick_rate + ban_rate).alias("popularity"),
        meta_strength(wr, pick_rate + ban_rate).alias("meta_strength"),
    )


def ban_priority(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Per champion: all bans, bans in the first two places, high-priority flag."""
    return ban_long(df, roles).groupBy("champion").agg(
        F.count("*").alias("total_bans"), F.count_if(F.col("ban_position") < 2).alias("early_bans")
    ).withColumn("high_priority", F.col("early_bans") > F.col("total_bans") * 0.5)


def ban_targets(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    return ban_long(df, roles, [roles.entity]).groupBy(roles.entity, "champion").agg(F.count("*").alias("bans"))


def signature(roles: Roles = MATCH, least_known: int = 3) -> Column:
    """Known champions of the row, sorted and joined by a bar; null below three."""
    known = F.filter(F.array(*[F.col(c) for c in roles.champions]), lambda x: x.isNotNull() & (x != UNKNOWN))
    return F.when(F.size(known) >= least_known, F.array_join(F.array_sort(known), "|"))


def composition_rates(df: DataFrame, roles: Roles = MATCH, min_games: int = 2) -> DataFrame:
    return (
        df.select(signature(roles).alias("signature"), roles.outcome)
        .filter("signature IS NOT NULL")
        .groupBy("signature")
        .agg(F.count(roles.outcome).alias("games"), F.sum(roles.outcome).alias("wins"))
        .filter(F.col("games") >= min_games)
        .withColumn("win_rate", F.col("wins") / F.col("games"))
    )


def game_pairs(df: DataFrame, columns: list[str], roles: Roles = MATCH) -> DataFrame:
    """One row per game with blue_* and red_* columns; exactly two rows, one per
    side. An aggregate by game, not a self-join: one shuffle, one scan."""
    row = F.struct(*[F.col(c) for c in columns])
    blue = F.col(roles.side) == "Blue"
    g = df.groupBy(roles.game).agg(
        F.count("*").alias("__n"), F.max(F.when(blue, row)).alias("b"), F.max(F.when(F.col(roles.side) == "Red", row)).alias("r")
    )
    return g.filter((F.col("__n") == 2) & F.col("b").isNotNull() & F.col("r").isNotNull()).select(
        roles.game, *[F.col(f"b.{c}").alias(f"blue_{c}") for c in columns], *[F.col(f"r.{c}").alias(f"red_{c}") for c in columns]
    )


def role_matchups(df: DataFrame, roles: Roles = MATCH, min_games: int = 3) -> DataFrame:
    """(role, champion, opponent): games and wins of actual lane opponents, both
    views of each game; unknown champions and mirrors skipped."""
    g = game_pairs(df, [roles.outcome, *roles.champions], roles)
    views = []
    for role, c in zip(ROLES, roles.champions):
        b, r = F.col(f"blue_{c}"), F.col(f"red_{c}")
        views.append(F.struct(F.lit(role).alias("role"), b.alias("champion"), r.alias("opponent"), F.col(f"blue_{roles.outcome}").alias("y")))
        views.append(F.struct(F.lit(role).alias("role"), r.alias("champion"), b.alias("opponent"), F.col(f"red_{roles.outcome}").alias("y")))
    ok = (F.col("champion") != UNKNOWN) & (F.col("opponent") != UNKNOWN) & (F.col("champion") != F.col("opponent"))
    return (
        g.select(F.explode(F.array(*views)).alias("x")).select("x.*").filter(ok)
        .groupBy("role", "champion", "opponent").agg(F.count("*").alias("games"), F.sum("y").alias("wins"))
        .filter(F.col("games") >= min_games)
        .withColumn("win_rate", F.col("wins") / F.col("games"))
    )


def cooccurrence_matchups(df: DataFrame, roles: Roles = MATCH, min_games: int = 3) -> DataFrame:
    """(role, champion, other): the first one's record over the patches in which
    both appear in the role. Not opponents: see role_matchups.

    Rows are first reduced to one per (role, patch, champion); the pairing then
    depends on the number of champions only, as does the result.
    """
    per = role_long(df, roles, [roles.patch, roles.outcome]).groupBy("role", roles.patch, "champion").agg(
        F.count(roles.outcome).alias("g"), F.sum(roles.outcome).alias("w")
    )
    other = per.select("role", roles.patch, F.col("champion").alias("opponent"))
    return (
        per.join(other, ["role", roles.patch]).filter(F.col("champion") != F.col("opponent"))
        .groupBy("role", "champion", "opponent").agg(F.sum("g").alias("games"), F.sum("w").alias("wins"))
        .filter(F.col("games") >= min_games)
        .withColumns({"advantage": F.col("wins") / F.col("games"), "confidence": F.least(F.col("games") / 10, F.lit(1.0))})
    )


def archetype_matchups(df: DataFrame, archetypes: DataFrame, roles: Roles = MATCH, min_games: int = 5) -> DataFrame:
    """Per role, each archetype's record credited against every other archetype
    that occurs. At most five names, so the others are an array literal."""
    present = archetypes.agg(F.collect_set("archetype")).scalar()
    rec = (
        role_long(df, roles, [roles.outcome]).groupBy("role", "champion")
        .agg(F.count(roles.outcome).alias("g"), F.sum(roles.outcome).alias("w"))
        .join(archetypes, "champion", "left")
        .groupBy("role", F.coalesce("archetype", F.lit(UNKNOWN)).alias("archetype"))
        .agg(F.sum("g").alias("games"), F.sum("w").alias("wins"))
        .filter(F.col("games") >= min_games)
    )
    names = F.array(*[F.lit(a) for a in ARCHETYPES])
    return (
        rec.select("*", F.explode(F.array_intersect(names, present)).alias("other"))
        .filter(F.col("archetype") != F.col("other"))
        .withColumn("advantage", F.col("wins") / F.col("games"))
    )


def peer_cross(df: DataFrame, roles: Roles = MATCH, min_games: int = 3) -> DataFrame:
    """(entity, peer): the entity's record in the leagues the peer also played in.
    Aggregated to (entity, league) first; the result itself is a pair table."""
    rec = df.groupBy(roles.entity, roles.league).agg(F.count(roles.outcome).alias("g"), F.sum(roles.outcome).alias("w"))
    peers = rec.select(roles.league, F.col(roles.entity).alias("peer"))
    return (
        rec.join(peers, roles.league).filter(F.col(roles.entity) != F.col("peer"))
        .groupBy(roles.entity, "peer").agg(F.sum("g").alias("games"), F.sum("w").alias("wins"))
        .filter(F.col("games") >= min_games)
        .withColumn("win_rate", F.col("wins") / F.col("games"))
    )


def peer_summary(df: DataFrame, roles: Roles = MATCH, min_games: int = 3) -> DataFrame:
    """Mean, consistency, favourable and unfavourable counts of peer_cross per
    entity, without making the pairs: peers with the same set of leagues have the
    same rate, so one row stands for all of them with its count."""
    rec = df.groupBy(roles.entity, roles.league).agg(F.count(roles.outcome).alias("g"), F.sum(roles.outcome).alias("w"))
    sets = rec.groupBy(roles.entity).agg(F.array_sort(F.collect_set(roles.league)).alias("leagues"))
    kinds = sets.groupBy("leagues").agg(F.count("*").alias("k"))
    probe = kinds.select("leagues", "k", F.explode("leagues").alias(roles.league))
    own = sets.select(F.col(roles.entity), F.col("leagues").alias("own"))
    rates = (
        rec.join(probe, roles.league)
        .groupBy(roles.entity, "leagues").agg(F.first("k").alias("k"), F.sum("g").alias("games"), F.sum("w").alias("wins"))
        .filter(F.col("games") >= min_games)
        .join(own, roles.entity)
        .select(
            roles.entity, (F.col("wins") / F.col("games")).alias("x"),
            (F.col("k") - (F.col("leagues") == F.col("own")).cast("int")).alias("k"),
        )
        .filter("k > 0")
    )
    n, m = F.sum("k"), F.sum(F.col("x") * F.col("k")) / F.sum("k")
    var = F.sum(F.col("x") * F.col("x") * F.col("k")) / n - m * m
    got = rates.groupBy(roles.entity).agg(
        m.alias("team_historical_advantage"),
        (1 - F.sqrt(F.greatest(var, F.lit(0.0)))).alias("team_matchup_consistency"),
        F.sum(F.when(F.col("x") > 0.6, F.col("k")).otherwise(0)).alias("favorable_matchups"),
        F.sum(F.when(F.col("x") < 0.4, F.col("k")).otherwise(0)).alias("unfavorable_matchups"),
    )
    return sets.select(roles.entity).join(got, roles.entity, "left").select(
        roles.entity,
        F.coalesce("team_historical_advantage", F.lit(0.5)).alias("team_historical_advantage"),
        F.coalesce("team_matchup_consistency", F.lit(1.0)).alias("team_matchup_consistency"),
        F.coalesce("favorable_matchups", F.lit(0)).alias("favorable_matchups"),
        F.coalesce("unfavorable_matchups", F.lit(0)).alias("unfavorable_matchups"),
    )


def head_to_head(df: DataFrame, roles: Roles = MATCH, min_games: int = 1) -> DataFrame:
    """(entity, opponent): games and wins actually played between the two."""
    g = game_pairs(df, [roles.entity, roles.outcome], roles)
    e, y = roles.entity, roles.outcome
    views = F.array(
        F.struct(F.col(f"blue_{e}").alias(e), F.col(f"red_{e}").alias("opponent"), F.col(f"blue_{y}").alias("y")),
        F.struct(F.col(f"red_{e}").alias(e), F.col(f"blue_{e}").alias("opponent"), F.col(f"red_{y}").alias("y")),
    )
    return (
        g.select(F.explode(views).alias("x")).select("x.*").filter(F.col(e) != F.col("opponent"))
        .groupBy(e, "opponent").agg(F.count("*").alias("games"), F.sum("y").alias("wins"))
        .filter(F.col("games") >= min_games)
        .withColumn("win_rate", F.col("wins") / F.col("games"))
    )


def lane_summary(df: DataFrame, roles: Roles = MATCH, archetypes: DataFrame | None = None) -> DataFrame:
    """Per role and champion (seen in any role): mean advantage and confidence over
    its co-occurring champions, and the mean advantage of its archetype in the role."""
    arch = champion_archetypes(champion_characteristics(df, roles)) if archetypes is None else archetypes
    lane = cooccurrence_matchups(df, roles).groupBy("role", "champion").agg(
        F.avg("advantage").alias("lane_advantage"), F.avg("confidence").alias("lane_confidence")
    )
    by_arch = archetype_matchups(df, arch, roles).groupBy("role", "archetype").agg(F.avg("advantage").alias("archetype_advantage"))
    seen = role_long(df, roles, []).groupBy("champion").agg(F.lit(1).alias("x"))
    names = seen.select("champion", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    return (
        names.join(lane, ["role", "champion"], "left").join(arch, "champion", "left")
        .withColumn("archetype", F.coalesce("archetype", F.lit("Balanced")))
        .join(by_arch, ["role", "archetype"], "left")
        .select(
            "role", "champion",
            F.coalesce("lane_advantage", F.lit(0.5)).alias("lane_advantage"),
            F.coalesce("lane_confidence", F.lit(0.1)).alias("lane_confidence"),
            F.coalesce("archetype_advantage", F.lit(0.5)).alias("archetype_advantage"),
        )
    )


def side_rates(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Per entity: blue and red win rates (0.5 if no game) and their difference."""
    blue = F.coalesce(F.col(roles.side), F.lit("Blue")) == "Blue"
    won = F.col(roles.outcome) == 1
    g = df.groupBy(roles.entity).agg(
        F.count_if(blue).alias("bg"), F.count_if(blue & won).alias("bw"), F.count_if(~blue).alias("rg"), F.count_if(~blue & won).alias("rw")
    )
    b, r = ratio(F.col("bw"), F.col("bg"), 0.5), ratio(F.col("rw"), F.col("rg"), 0.5)
    return g.select(roles.entity, b.alias("blue_side_winrate"), r.alias("red_side_winrate"), (b - r).alias("side_preference"))


def patch_rates(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Per (entity, patch): win rate, and its difference to the entity's overall
    rate. The overall rate is rolled up from the same small table."""
    tp = df.groupBy(roles.entity, roles.patch).agg(F.count(roles.outcome).alias("g"), F.sum(roles.outcome).alias("w"))
    t = tp.groupBy(roles.entity).agg((F.sum("w") / F.sum("g")).alias("overall"))
    rate = F.col("w") / F.col("g")
    return tp.join(t, roles.entity).select(
        roles.entity, roles.patch, F.col("g").alias("patch_games"), rate.alias("patch_win_rate"), (rate - F.col("overall")).alias("patch_adaptation_rate")
    )


def league_rates(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Per (entity, league): win rate, dominance over the overall rate, share of
    five leagues the entity has played in."""
    tl = df.groupBy(roles.entity, roles.league).agg(F.count(roles.outcome).alias("g"), F.sum(roles.outcome).alias("w"))
    t = tl.groupBy(roles.entity).agg((F.sum("w") / F.sum("g")).alias("overall"), F.least(F.count("*") / 5, F.lit(1.0)).alias("cross_league_experience"))
    rate = F.col("w") / F.col("g")
    return tl.join(t, roles.entity).select(
        roles.entity, roles.league, rate.alias("league_specific_winrate"), (rate - F.col("overall")).alias("league_dominance"), "cross_league_experience"
    )


def popular_champions(df: DataFrame, roles: Roles = MATCH, top: int = 10) -> DataFrame:
    """The most picked champions of each patch, ties by name."""
    c = role_long(df, roles, [roles.patch]).groupBy(roles.patch, "champion").agg(F.count("*").alias("picks"))
    w = Window.partitionBy(roles.patch).orderBy(F.desc("picks"), "champion")
    return c.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def fallback_rates(df: DataFrame, roles: Roles = MATCH, min_games: int = 10) -> DataFrame:
    """(kind, name, value): role means of the champions' rates, league means and
    the global mean."""
    champ = role_long(df, roles, [roles.outcome], unknown=True).filter("champion IS NOT NULL").groupBy("role", "champion").agg(
        F.count(roles.outcome).alias("n"), F.sum(roles.outcome).alias("w")
    )
    known = champ.filter(F.col("n") >= min_games).groupBy("role").agg(F.avg(F.col("w") / F.col("n")).alias("v"))
    all_roles = champ.select("role").distinct().join(known, "role", "left").select(
        F.lit("role").alias("kind"), F.col("role").alias("name"), F.coalesce("v", F.lit(0.5)).alias("value")
    )
    league = df.groupBy(roles.league).agg(F.count(roles.outcome).alias("n"), F.sum(roles.outcome).alias("w"))
    by_league = league.select(F.lit("league").alias("kind"), F.col(roles.league).alias("name"), (F.col("w") / F.col("n")).alias("value"))
    overall = league.agg((F.sum("w") / F.sum("n")).alias("value")).select(F.lit("global").alias("kind"), F.lit("all").alias("name"), "value")
    return all_roles.unionByName(by_league).unionByName(overall)


def team_counts(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    return df.groupBy(roles.entity).agg(F.count("*").alias("team_rows"))


def champion_counts(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    return role_long(df, roles, [], unknown=True).filter("champion IS NOT NULL").groupBy("champion").agg(F.count("*").alias("champion_rows"))


def known_summary(df: DataFrame, roles: Roles = MATCH, team_rows: int = 10, champion_rows: int = 20) -> DataFrame:
    """One row: known champions, teams and patches, and how many have enough rows."""
    t = team_counts(df, roles).select(F.lit("team").alias("kind"), (F.col("team_rows") >= team_rows).alias("enough"))
    c = champion_counts(df, roles).select(F.lit("champion").alias("kind"), (F.col("champion_rows") >= champion_rows).alias("enough"))
    p = df.groupBy(roles.patch).agg(F.lit("patch").alias("kind")).select("kind", F.lit(True).alias("enough"))
    return t.unionByName(c).unionByName(p).agg(
        F.count_if(F.col("kind") == "champion").alias("known_champions"),
        F.count_if(F.col("kind") == "team").alias("known_teams"),
        F.count_if(F.col("kind") == "patch").alias("known_patches"),
        F.count_if((F.col("kind") == "team") & F.col("enough")).alias("reliable_teams"),
        F.count_if((F.col("kind") == "champion") & F.col("enough")).alias("reliable_champions"),
    )


# Upper edges (closed) of the tiers, weakest first.
TIERS = ((0.3, "Low"), (0.45, "Below_Avg"), (0.55, "Average"), (0.7, "Above_Avg"), (1.0, "High"))


def team_tiers(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Win rate cut into (lo, hi] tiers; a rate of exactly 0 has none."""
    g = df.groupBy(roles.entity).agg((F.sum(roles.outcome) / F.count(roles.outcome)).alias("win_rate"))
    tier = F.when(F.col("win_rate") <= 0, F.lit(None))
    for hi, name in TIERS:
        tier = tier.when(F.col("win_rate") <= hi, F.lit(name))
    return g.withColumn("tier", tier)


def tier_mix(df: DataFrame, tag: str, roles: Roles = MATCH) -> DataFrame:
    """Share of each tier within each split. Counts by (split, entity) come first."""
    c = df.groupBy(tag, roles.entity).agg(F.count("*").alias("n")).join(team_tiers(df, roles), roles.entity)
    m = c.filter("tier IS NOT NULL").groupBy(tag, "tier").agg(F.sum("n").alias("rows"))
    return m.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(tag)))


def dataset_statistics(df: DataFrame, keys: list[str], roles: Roles = MATCH, approx: bool = False) -> DataFrame:
    """Rows, distinct games, teams and patches, date range, mean outcome by group."""
    d = F.approx_count_distinct if approx else F.countDistinct
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), d(roles.game).alias("games"), d(roles.entity).alias("teams"), d(roles.patch).alias("patches"),
        F.min(roles.time).alias("first_date"), F.max(roles.time).alias("last_date"), (F.sum(roles.outcome) / F.count(roles.outcome)).alias("win_rate"),
    )
