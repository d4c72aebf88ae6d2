"""Features of an entity's own past. Order is (time, row id); the current row and
later rows never enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.scalar import patch_number, ratio
from boutline.plans.bounded import bounded
from boutline.plans.ordered import HOT_ROWS, Past, history, time_levels
from boutline.roles import MATCH, UNKNOWN, Roles


def _half(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.5))


def _setup(df: DataFrame, roles: Roles):
    return [roles.time, roles.row], time_levels(df, roles.time, roles.row)


def entity_form(df: DataFrame, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """All features of the entity's past, from one shuffle on the entity.

    Adds games_played, wins_before, overall_winrate, recent_winrate, form_trend,
    winrate_last_3/5/10, form_momentum_short, performance_volatility,
    current_streak, games_on_patch, patch_experience, patch_performance and
    league_recent. Unused ones are pruned by the optimizer.
    """
    order, levels = _setup(df, roles)
    y = F.col(roles.outcome)
    at = F.col("games_played")
    pasts = [
        Past(
            [roles.entity],
            "games_played",
            totals={"wins_before": ("sum", y)},
            late={
                "__last_win": ("max", F.when(y == 1, at)),
                "__last_loss": ("max", F.when(y == 0, at)),
            },
            frames={
                "__r3": (F.avg, y, 3),
                "__r5": (F.avg, y, 5),
                "__r10": (F.avg, y, 10),
                "__s10": (F.stddev_samp, y, 10),
            },
        ),
        Past([roles.entity, roles.patch], "games_on_patch", totals={"__patch_wins": ("sum", y)}),
        Past([roles.entity, roles.league], "__league_games", frames={"__league_r5": (F.avg, y, 5)}),
    ]
    h = history(df, [roles.entity], pasts, order, levels, hot_rows)
    win, loss = F.coalesce("__last_win", F.lit(-1)), F.coalesce("__last_loss", F.lit(-1))
    overall = ratio(F.col("wins_before"), at, 0.5)
    recent = _half(F.col("__r10"))
    new = {
        "overall_winrate": overall,
        "recent_winrate": recent,
        "form_trend": recent - overall,
        "winrate_last_3": _half(F.col("__r3")),
        "winrate_last_5": _half(F.col("__r5")),
        "winrate_last_10": recent,
        "form_momentum_short": _half(F.col("__r3")) - recent,
        "performance_volatility": F.when(at >= 3, F.col("__s10")).otherwise(F.lit(0.5)),
        # the run that ends at the previous row: its distance from the last opposite result
        "current_streak": F.when(at == 0, F.lit(0).cast("long")).otherwise(win - loss),
        "patch_experience": F.col("games_on_patch") + 1,
        "patch_performance": ratio(F.col("__patch_wins"), F.col("games_on_patch"), 0.5),
        "league_recent": _half(F.col("__league_r5")),
    }
    out = h.withColumns(new)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def versus_league(df: DataFrame, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """league_recent minus the league's mean outcome (a small aggregate, joined)."""
    league = df.groupBy(roles.league).agg((F.sum(roles.outcome) / F.count(roles.outcome)).alias("__lm"))
    return (
        entity_form(df, roles, hot_rows)
        .join(bounded(league), roles.league)
        .withColumn("vs_league_avg", F.col("league_recent") - F.col("__lm"))
        .drop("__lm")
    )


def patch_use(df: DataFrame, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Games on the patch so far and the flags derived from it."""
    out = entity_form(df, roles, hot_rows)
    norm = F.least(F.col("games_on_patch") / 20, F.lit(1.0))
    early = (F.col("games_on_patch") < 3).cast("int")
    return out.withColumns(
        {
            "early_patch_indicator": early,
            "games_on_patch_normalized": norm,
            "patch_experience_advantage": norm * (1 - early),
        }
    )


def role_long(df: DataFrame, roles: Roles = MATCH, keep: list[str] | None = None, players: bool = False, unknown: bool = False) -> DataFrame:
    """One row per (row, role): champion, ban position and player, one scan."""
    from boutline.roles import ROLES

    keep = [roles.row, roles.outcome] if keep is None else keep
    items = []
    for i, role in enumerate(ROLES):
        f = [F.lit(role).alias("role"), F.col(roles.champions[i]).alias("champion")]
        if players:
            f.append(F.col(roles.players[i]).alias("player"))
        items.append(F.struct(*f))
    out = df.select(*keep, F.explode(F.array(*items)).alias("__x")).select(*keep, "__x.*")
    return out if unknown else out.filter(F.col("champion").isNotNull() & (F.col("champion") != UNKNOWN))


def ban_long(df: DataFrame, roles: Roles = MATCH, keep: list[str] | None = None) -> DataFrame:
    from boutline.roles import NO_BAN

    keep = [roles.row] if keep is None else keep
    items = F.array(*[F.struct(F.lit(i).alias("ban_position"), F.col(b).alias("champion")) for i, b in enumerate(roles.bans)])
    return (
        df.select(*keep, F.explode(items).alias("__x"))
        .select(*keep, "__x.*")
        .filter(F.col("champion").isNotNull() & (F.col("champion") != NO_BAN))
    )


def player_form(df: DataFrame, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per (row, role): the player's and the (player, champion)'s past.

    Unknown players have no past: they keep the defaults.
    """
    order, levels = _setup(df, roles)
    long = role_long(df, roles, [roles.row, roles.time, roles.outcome], players=True, unknown=True)
    y = F.col(roles.outcome)
    known = long.filter(F.col("player").isNotNull() & (F.col("player") != UNKNOWN))
    h = history(
        known,
        ["player"],
        [
            Past(["player"], "player_games", totals={"__pw": ("sum", y)}, frames={"__pr": (F.avg, y, 10)}),
            Past(["player", "champion"], "champion_games", totals={"__cw": ("sum", y)}),
        ],
        order,
        levels,
        hot_rows,
    )
    stats = {
        "player_winrate": ratio(F.col("__pw"), F.col("player_games"), 0.5),
        "player_recent": _half(F.col("__pr")),
        "champion_mastery": ratio(F.col("__cw"), F.col("champion_games"), 0.5),
    }
    cols = [roles.row, "role", "player", "champion", "player_games", "champion_games"]
    unknown = long.filter(F.col("player").isNull() | (F.col("player") == UNKNOWN)).select(
        roles.row, "role", "player", "champion", F.lit(0).cast("long").alias("player_games"), F.lit(0).cast("long").alias("champion_games"),
        *[F.lit(0.5).alias(n) for n in stats],
    )
    return h.select(*cols, *[c.alias(n) for n, c in stats.items()]).unionByName(unknown)


def player_features(df: DataFrame, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The seven player features of each row."""
    pf = player_form(df, roles, hot_rows)
    form = F.col("player_recent") - F.col("player_winrate")
    out = pf.groupBy(roles.row).agg(
        F.avg("player_winrate").alias("team_avg_player_winrate"),
        F.avg("player_recent").alias("team_avg_player_recent"),
        F.avg(F.least(F.col("player_games") / 100, F.lit(1.0))).alias("team_avg_player_experience"),
        F.avg("champion_mastery").alias("team_avg_champion_mastery"),
        F.min("champion_mastery").alias("team_min_champion_mastery"),
        F.avg(form).alias("team_player_form"),
    )
    return out.withColumn("player_mastery_experience_interaction", F.col("team_avg_champion_mastery") * F.col("team_avg_player_experience"))


def patch_statistics(df: DataFrame, roles: Roles = MATCH, min_rows: int = 10) -> DataFrame:
    """Per patch: distinct champions over the roles, rows, mean length, variance of
    the entities' means, entities. Two-step aggregates, no hot group."""
    per_team = df.groupBy(roles.patch, roles.entity).agg(
        F.count("*").alias("n"), F.sum(roles.outcome).alias("w"), F.count(roles.outcome).alias("nw"), F.sum(roles.length).alias("len")
    )
    base = per_team.groupBy(roles.patch).agg(
        F.sum("n").alias("patch_games"),
        (F.sum("len") / F.sum("n")).alias("avg_game_length"),
        F.coalesce(F.var_samp(F.col("w") / F.col("nw")), F.lit(0.0)).alias("win_rate_variance"),
        F.count("*").alias("unique_teams"),
    ).filter(F.col("patch_games") >= min_rows)
    champs = (
        role_long(df, roles, [roles.patch], unknown=True)
        .filter("champion IS NOT NULL")
        .groupBy(roles.patch, "champion").agg(F.lit(1).alias("x"))
        .groupBy(roles.patch).agg(F.count("*").alias("champion_diversity"))
    )
    return base.join(champs, roles.patch)


def patch_shift(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Change of each patch against the one before it: diversity, length, balance,
    stability, and the mean absolute change of first-role pick shares.

    Rows are reduced to (patch, first champion) counts; the sequence of patches, in
    version order, is a window over one row per patch.
    """
    pc = df.groupBy(roles.patch, F.col(roles.champions[0]).alias("champion")).agg(F.count("*").alias("n"))
    w = Window.orderBy("__no", roles.patch)
    stat = F.struct("champion_diversity", "avg_game_length", "win_rate_variance")
    seq = (
        pc.groupBy(roles.patch).agg(F.sum("n").alias("patch_games_count")).withColumn("__no", patch_number(roles.patch))
        .join(patch_statistics(df, roles).select(roles.patch, stat.alias("now")), roles.patch, "left")
        .withColumns(
            {
                "was": F.lag("now").over(w), "prev_n": F.lag("patch_games_count").over(w),
                "next": F.lead(roles.patch).over(w), "next_n": F.lead("patch_games_count").over(w),
            }
        )
    )
    d = (F.col("now.champion_diversity") - F.col("was.champion_diversity")) / F.col("was.champion_diversity")
    g = (F.col("now.avg_game_length") - F.col("was.avg_game_length")) / F.col("was.avg_game_length")
    b = F.abs(F.col("now.win_rate_variance") - F.col("was.win_rate_variance"))
    # a share counts for its own patch and, negated, for the next: no full outer join
    few = 5
    share = F.col("n") / F.col("patch_games_count")
    enough = F.col("patch_games_count") >= few
    sides = F.array(
        F.when(enough & (F.col("prev_n") >= few), F.struct(F.col(roles.patch).alias("own"), share.alias("share"))),
        F.when(enough & (F.col("next_n") >= few), F.struct(F.col("next").alias("own"), (-share).alias("share"))),
    )
    pick = (
        pc.join(seq.select(roles.patch, "patch_games_count", "prev_n", "next", "next_n"), roles.patch)
        .select("champion", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x"))
        .groupBy("x.own", "champion").agg(F.abs(F.sum("x.share")).alias("v"))
        .groupBy("own").agg(F.avg("v").alias("pick_shift_magnitude"))
        .withColumnRenamed("own", roles.patch)
    )
    out = seq.join(pick, roles.patch, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stability = F.coalesce(1 - (F.abs(d) + F.abs(g) + b) / 3, F.lit(1.0))
    return out.select(
        roles.patch, "patch_games_count", zero(d).alias("diversity_shift"), zero(g).alias("game_length_shift"), zero(b).alias("balance_shift"),
        stability.alias("patch_stability"), zero(F.col("pick_shift_magnitude")).alias("pick_shift_magnitude"), (1 - stability).alias("meta_shift_magnitude"),
    )


def meta_adaptation(df: DataFrame, shifts: DataFrame, roles: Roles = MATCH, unstable: float = 0.7, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mean of the entity's earlier outcomes on unstable patches; 0.5 until it has
    more than five earlier games."""
    order, levels = _setup(df, roles)
    s = shifts.select(roles.patch, "patch_stability")
    # one row per patch: as long as the release calendar
    src = df.join(F.broadcast(s), roles.patch, "left").withColumn("patch_stability", F.coalesce("patch_stability", F.lit(1.0)))
    high = F.col("patch_stability") < unstable
    h = history(
        src, [roles.entity],
        [Past([roles.entity], "__n", totals={"__hw": ("sum", F.when(high, F.col(roles.outcome)).otherwise(0)), "__hn": ("sum", high.cast("int"))})],
        order, levels, hot_rows,
    )
    return h.withColumn(
        "team_meta_adaptation", F.when(F.col("__n") > 5, ratio(F.col("__hw"), F.col("__hn"), 0.5)).otherwise(F.lit(0.5))
    ).drop("__n", "__hw", "__hn")


def latest_form(df: DataFrame, roles: Roles = MATCH, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Snapshot per entity *after* its last row: what the next game will see.

    Every row carries the nine outcomes before it as a sum, so the last row of an
    entity, found by an aggregate, tells all: one pass, nothing collected.
    """
    order, levels = _setup(df, roles)
    y, at = F.col(roles.outcome), F.col("n")
    h = history(
        df.select(roles.entity, roles.time, roles.row, roles.outcome),
        [roles.entity],
        [
            Past(
                [roles.entity], "n", totals={"w": ("sum", y)},
                late={"lw": ("max", F.when(y == 1, at)), "ll": ("max", F.when(y == 0, at))},
                frames={"s9": (F.sum, y, 9), "c9": (F.count, y, 9)},
            )
        ],
        order, levels, hot_rows,
    )
    x = h.groupBy(roles.entity).agg(F.max_by(F.struct("n", "w", y.alias("y"), "lw", "ll", "s9", "c9"), F.struct(*order)).alias("x")).select(roles.entity, "x.*")
    games, overall = F.col("n") + 1, (F.col("w") + F.col("y")) / (F.col("n") + 1)
    recent = (F.coalesce("s9", F.lit(0)) + F.col("y")) / (F.col("c9") + 1)
    win = F.when(F.col("y") == 1, F.col("n")).otherwise(F.coalesce("lw", F.lit(-1)))
    loss = F.when(F.col("y") == 0, F.col("n")).otherwise(F.coalesce("ll", F.lit(-1)))
    return x.select(
        roles.entity, games.alias("games_played"), overall.alias("overall_winrate"), recent.alias("recent_winrate"),
        (recent - overall).alias("form_trend"), (win - loss).cast("long").alias("current_streak"),
    )


def latest_player(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Per (player, champion) totals, and per player through them: two map-side sums."""
    long = role_long(df, roles, [roles.row, roles.time, roles.outcome], players=True, unknown=True).filter(
        F.col("player").isNotNull() & (F.col("player") != UNKNOWN)
    )
    pc = long.groupBy("player", "champion").agg(F.count("*").alias("champion_games"), F.sum(roles.outcome).alias("champion_wins"))
    p = pc.groupBy("player").agg(F.sum("champion_games").alias("player_games"), F.sum("champion_wins").alias("player_wins"))
    return pc.join(p, "player").select(
        "player", "champion", "player_games", "champion_games",
        (F.col("player_wins") / F.col("player_games")).alias("player_winrate"),
        (F.col("champion_wins") / F.col("champion_games")).alias("champion_mastery"),
    )
