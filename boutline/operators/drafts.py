"""Prospective games: checks, names, fallbacks, candidates and suggestions.

A draft row has draft_id, blue_team, red_team, blue_picks and red_picks
(map role -> champion), blue_bans and red_bans (array), optional players maps
and patch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.scalar import patch_part
from boutline.operators import lookups
from boutline.plans.bounded import bounded
from boutline.roles import MATCH, NO_BAN, ROLE_PREFIX, ROLES, UNKNOWN, Roles

# Penalties of edge cases, their sum's cap, row counts that suffice.
PENALTY = {"new_team": 0.20, "new_champion": 0.15, "new_patch": 0.10, "low_sample_team": 0.10, "low_sample_champion": 0.05, "several": 0.05}
PENALTY_CAP = 0.5
ENOUGH_TEAM, ENOUGH_CHAMPION = 10, 20


def side_rows(drafts: DataFrame, context: dict[str, Column] | None = None) -> DataFrame:
    """Two match-like rows per draft, in the columns the feature model reads."""
    context = context or {}

    def side(s, name):
        p, b = F.col(f"{s}_picks"), F.col(f"{s}_bans")
        f = [F.lit(name).alias("side"), F.col(f"{s}_team").alias("team")]
        f += [F.coalesce(p[r], F.lit(UNKNOWN)).alias(f"{x}_champion") for r, x in zip(ROLES, ROLE_PREFIX)]
        f += [F.coalesce(F.get(b, F.lit(i)), F.lit(NO_BAN)).alias(f"ban{i + 1}") for i in range(5)]
        if f"{s}_players" in drafts.columns:
            f += [F.coalesce(F.col(f"{s}_players")[r], F.lit(UNKNOWN)).alias(f"{x}_player") for r, x in zip(ROLES, ROLE_PREFIX)]
        return F.struct(*f)

    keep = [c for c in ("draft_id", "patch", "league", "split_name", "year", "playoffs", "swaps") if c in drafts.columns]
    out = drafts.select(*keep, F.explode(F.array(side("blue", "Blue"), side("red", "Red"))).alias("x")).select(*keep, "x.*")
    out = out.withColumns({k: v for k, v in context.items() if k not in out.columns})
    return out.withColumn("row_id", F.col("draft_id") * 2 + (F.col("side") == "Red").cast("int"))


def validate(drafts: DataFrame, champions: DataFrame, teams: DataFrame) -> DataFrame:
    """(draft_id, error), one row per error; a draft without any has none.

    Known names are one array each (as many entries as there are names).
    """
    known_c = champions.agg(F.collect_set("champion")).scalar()
    known_t = teams.agg(F.collect_set("team")).scalar()
    roles = F.array(*[F.lit(r) for r in ROLES])
    text = lambda prefix: lambda x: F.concat(F.lit(prefix), x)
    errs: list[Column] = []
    d = drafts.withColumns({"__c": known_c, "__t": known_t})
    for s in ("blue", "red"):
        picks, bans = F.col(f"{s}_picks"), F.col(f"{s}_bans")
        none = F.array().cast("array<string>")
        lacking = F.array_except(roles, F.map_keys(picks))
        extra = F.array_except(F.map_keys(picks), roles)
        errs += [
            F.when(~F.array_contains(F.col("__t"), F.col(f"{s}_team")), F.array(F.concat(F.lit(f"{s}: unknown team "), F.col(f"{s}_team")))).otherwise(none),
            F.transform(lacking, text(f"{s}: missing role ")),
            F.transform(extra, text(f"{s}: unknown role ")),
            F.when(F.size(bans) != 5, F.array(F.concat(F.lit(f"{s}: expected 5 bans, got "), F.size(bans).cast("string")))).otherwise(none),
            F.transform(
                F.filter(F.array_except(F.concat(F.map_values(picks), bans), F.col("__c")), lambda c: c != NO_BAN),
                text(f"{s}: unknown champion "),
            ),
        ]
    every = F.filter(F.concat(F.map_values("blue_picks"), F.map_values("red_picks"), F.col("blue_bans"), F.col("red_bans")), lambda c: c != NO_BAN)
    again = F.filter(F.array_distinct(every), lambda c: F.size(F.filter(every, lambda x: x == c)) > 1)
    errs.append(F.transform(again, text("duplicate champion ")))
    return d.select("draft_id", F.explode(F.concat(*errs)).alias("error"))


# Pieces of a name that may be spared, and names from which on a piece counts as common.
MORE_PIECES = 4
COMMON_PIECE = 50


def resolve_names(queries: DataFrame, known: DataFrame, aliases: DataFrame | None = None, distance: int = 2, top: int = 3) -> DataFrame:
    """(query, resolved, how, suggestion, edit_distance, place).

    An alias, then equality without case, then up to ``top`` names within the edit
    distance. Candidates share a piece: a known name is cut into distance + m pieces, of
    which every name within the distance contains m near their places. So it is enough
    to index all but m - 1 of them, and those left out are the commonest: what half of
    the names begin with joins nothing. That is exact, and no name meets all others.
    """
    q = queries.select("query").distinct()
    names = known.select("name").distinct().withColumn("low", F.lower("name"))
    if aliases is not None:
        al = aliases.select(F.lower("alias").alias("__a"), F.col("name").alias("__alias"))
        q = q.join(al, F.lower("query") == F.col("__a"), "left").drop("__a")
    else:
        q = q.withColumn("__alias", F.lit(None).cast("string"))
    canon = names.groupBy("low").agg(F.min("name").alias("__same"))
    q = q.withColumn("low_q", F.lower(F.trim("query"))).join(canon, F.col("low_q") == F.col("low"), "left").drop("low")
    found = q.filter("__alias IS NOT NULL OR __same IS NOT NULL").select(
        "query", F.coalesce("__alias", "__same").alias("resolved"), F.when(F.col("__alias").isNotNull(), "alias").otherwise("name").alias("how"),
        F.lit("").alias("suggestion"), F.lit(0).alias("edit_distance"), F.lit(0).alias("place"),
    )
    k = distance
    # pieces of a name of n letters: one more than needed for each 3 letters it can spare
    many = lambda n: F.lit(k) + F.greatest(F.lit(1), F.least(F.lit(MORE_PIECES), F.floor(n / 3).cast("int") - k))
    piece_len = lambda n, i: F.floor(n / many(n)) + (i >= many(n) - n % many(n)).cast("int")
    piece_at = lambda n, i: i * F.floor(n / many(n)) + F.greatest(F.lit(0), i - (many(n) - n % many(n)))
    pieces = lambda n: F.sequence(F.lit(0), many(n) - 1)
    kn = names.withColumn("n", F.length("low")).select("name", "low", "n", F.explode(pieces(F.col("n"))).alias("i"))
    kn = kn.select("name", "low", "n", "i", F.substring(F.col("low"), (piece_at(F.col("n"), F.col("i")) + 1).cast("int"), piece_len(F.col("n"), F.col("i")).cast("int")).alias("piece"))
    common = kn.groupBy("n", "i", "piece").agg(F.count("*").alias("__often")).filter(F.col("__often") >= COMMON_PIECE)
    rare = Window.partitionBy("name").orderBy(F.coalesce("__often", F.lit(0)), "i")
    kn = kn.join(bounded(common), ["n", "i", "piece"], "left").withColumn("__r", F.row_number().over(rare)).filter(F.col("__r") <= k + 1).drop("__r", "__often")
    open_q = q.filter("__alias IS NULL AND __same IS NULL").select("query", "low_q", F.length("low_q").alias("m"))
    qs = open_q.select("*", F.explode(F.sequence(F.greatest(F.col("m") - k, F.lit(1)), F.col("m") + k)).alias("n"))
    qs = qs.select("*", F.explode(pieces(F.col("n"))).alias("i"))
    at, ln = piece_at(F.col("n"), F.col("i")), piece_len(F.col("n"), F.col("i"))
    qs = qs.withColumns({"__f": F.greatest(at - k, F.lit(0)).cast("int"), "__l": F.least(at + k, F.col("m") - ln).cast("int"), "__n": ln.cast("int")}).filter("__f <= __l")
    qs = qs.select("query", "low_q", "n", "i", "__n", F.explode(F.sequence("__f", "__l")).alias("s"))
    qs = qs.select("query", "low_q", "n", "i", F.substring(F.col("low_q"), F.col("s") + 1, F.col("__n")).alias("piece")).distinct()
    cand = qs.join(kn, ["n", "i", "piece"]).select("query", "low_q", "name", "low").distinct()
    near = cand.withColumn("edit_distance", F.levenshtein("low_q", "low")).filter(F.col("edit_distance") <= k)
    w = Window.partitionBy("query").orderBy("edit_distance", "name")
    best = near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("query", F.col("name").alias("suggestion"), "edit_distance", "place")
    rest = open_q.select("query").join(best, "query", "left").select(
        "query", F.lit("").alias("resolved"), F.when(F.col("place").isNull(), "unknown").otherwise("suggested").alias("how"),
        F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.coalesce("edit_distance", F.lit(0)).alias("edit_distance"), F.coalesce("place", F.lit(0)).alias("place"),
    )
    return found.unionByName(rest)


def nearest_patch(patches: DataFrame, known: DataFrame, patch: str = "patch") -> DataFrame:
    """(patch, nearest): the known patch of least 100*|major|+|minor| difference.
    Known patches are one array, as long as the release calendar."""
    have = known.select(F.struct(patch_part(patch, 0).alias("a"), patch_part(patch, 1).alias("b"), F.col(patch).alias("p")).alias("s")).distinct()
    arr = have.agg(F.array_sort(F.collect_list("s"))).scalar()
    a, b = patch_part(patch, 0), patch_part(patch, 1)
    d = patches.select(patch).distinct().withColumns({"__a": a, "__b": b, "__k": arr})
    dist = F.transform("__k", lambda x: F.struct((F.abs(x["a"] - F.col("__a")) * 100 + F.abs(x["b"] - F.col("__b"))).alias("d"), x["a"].alias("a"), x["b"].alias("b"), x["p"].alias("p")))
    return d.select(patch, F.array_min(dist)["p"].alias("nearest"))


class KnownEntities:
    """Counts of the training rows that tell new from known."""

    def __init__(self, train: DataFrame, roles: Roles = MATCH):
        self.roles = roles
        self.teams = lookups.team_counts(train, roles)
        self.champions = lookups.champion_counts(train, roles)
        self.patches = train.select(roles.patch).distinct()
        self.fallback = lookups.fallback_rates(train, roles)


def edge_cases(df: DataFrame, known: KnownEntities) -> DataFrame:
    """Per row: flags (sorted names joined by a comma), penalty and new champions.

    Champions come as one map of counts (one entry per champion), so five lookups
    need no join; teams and patches are joined.
    """
    r = known.roles
    cmap = known.champions.agg(F.map_from_entries(F.collect_list(F.struct("champion", "champion_rows")))).scalar()
    pset = known.patches.agg(F.collect_set(r.patch)).scalar()
    d = df.join(known.teams, r.entity, "left").withColumns({"__m": cmap, "__p": pset})
    counts = [F.when(F.col(c).isNotNull(), F.coalesce(F.element_at("__m", F.col(c)), F.lit(0))) for c in r.champions]
    d = d.withColumns({f"__n{i}": c for i, c in enumerate(counts)})
    new_c = reduce(lambda a, b: a + b, [F.coalesce((F.col(f"__n{i}") == 0).cast("int"), F.lit(0)) for i in range(5)])
    low_c = reduce(lambda a, b: a + b, [F.coalesce(((F.col(f"__n{i}") > 0) & (F.col(f"__n{i}") < ENOUGH_CHAMPION)).cast("int"), F.lit(0)) for i in range(5)])
    d = d.withColumns({"new_champions": new_c, "low_sample_champions": low_c})
    t = F.coalesce("team_rows", F.lit(0))
    flag = {
        "low_sample_champion": F.col("low_sample_champions") > 0, "low_sample_team": (t > 0) & (t < ENOUGH_TEAM),
        "new_champion": F.col("new_champions") > 0, "new_patch": ~F.array_contains("__p", F.col(r.patch)), "new_team": t == 0,
    }
    flags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flag.items()]), lambda x: x.isNotNull())
    pen = (
        F.when(flag["new_team"], PENALTY["new_team"]).when(flag["low_sample_team"], PENALTY["low_sample_team"]).otherwise(0.0)
        + F.col("new_champions") * PENALTY["new_champion"] + F.col("low_sample_champions") * PENALTY["low_sample_champion"]
        + F.when(flag["new_patch"], PENALTY["new_patch"]).otherwise(0.0)
        + F.when(F.size(flags) > 1, PENALTY["several"]).otherwise(0.0)
    )
    out = d.withColumns({"edge_cases": F.array_join(flags, ","), "confidence_penalty": F.least(pen, F.lit(PENALTY_CAP))})
    return out.select(*df.columns, "edge_cases", "new_champions", "low_sample_champions", "confidence_penalty", *[f"__n{i}" for i in range(5)])


def apply_fallback(df: DataFrame, known: KnownEntities) -> DataFrame:
    """Rows with edge cases and the value that stands in: role mean for a new
    champion, league mean for a new team (else the global mean), nearest patch."""
    r = known.roles
    e = edge_cases(df, known)
    near = nearest_patch(df, known.patches, r.patch)
    fmap = known.fallback.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "name"), "value")))).scalar()
    out = e.join(near, r.patch, "left").withColumn("__f", fmap)
    new_team = F.contains(F.col("edge_cases"), F.lit("new_team"))
    rates = {
        f"{p}_fallback": F.when(F.col(f"__n{i}") == 0, F.element_at("__f", F.lit(f"role:{role}"))) for i, (p, role) in enumerate(zip(ROLE_PREFIX, ROLES))
    }
    out = out.withColumns(
        {
            "team_fallback": F.when(new_team, F.coalesce(F.element_at("__f", F.concat(F.lit("league:"), F.col(r.league))), F.element_at("__f", F.lit("global:all")))),
            "patch_used": F.when(F.contains(F.col("edge_cases"), F.lit("new_patch")), F.col("nearest")).otherwise(F.col(r.patch)),
            **rates,
        }
    )
    return out.drop("__f", "nearest", *[f"__n{i}" for i in range(5)])


def with_swaps(drafts: DataFrame, meta: DataFrame, top: int = 5, how: str = "left") -> DataFrame:
    """Drafts with ``swaps``: the best champions by meta strength on the draft's patch (structs
    with champion and meta_strength, best first) that are neither picked nor banned.

    A draft uses at most 20 champions, so the first 20 + top of a patch contain the
    answer: the join brings a fixed number of rows per draft.
    """
    w = Window.partitionBy("patch").orderBy(F.desc("meta_strength"), "champion")
    best = meta.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= 20 + top)
    ranked = best.groupBy("patch").agg(F.array_sort(F.collect_list(F.struct("__r", "champion", "meta_strength"))).alias("__best"))
    used = F.array_distinct(F.concat(F.map_values("blue_picks"), F.map_values("red_picks"), F.col("blue_bans"), F.col("red_bans")))
    free = F.slice(F.filter("__best", lambda x: ~F.array_contains("__u", x["champion"])), 1, top)
    out = drafts.withColumn("__u", used).join(F.broadcast(ranked), "patch", how)  # one row per patch
    return out.withColumn("swaps", free).drop("__u", "__best")


def swap_candidates(drafts: DataFrame, meta: DataFrame, side: str = "blue", top: int = 5) -> DataFrame:
    """(draft_id, role, champion, place): for every role, the draft's :func:`with_swaps`."""
    return (
        with_swaps(drafts, meta, top, "inner").select("draft_id", F.posexplode("swaps").alias("i", "x"))
        .select("draft_id", "x.champion", "x.meta_strength", (F.col("i") + 1).alias("place"), F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    )


def resolve_suggestions(gains: DataFrame, least: float = 0.5, top: int = 5, keys: tuple[str, ...] = ("draft_id",)) -> DataFrame:
    """Per draft (or ``keys``), from (keys..., role, champion, gain): best first, each role and
    champion once, at most ``top``. A draft has at most 25 candidates (five roles,
    five champions), folded in one row."""
    item = F.struct((-F.col("gain")).alias("g"), "role", "champion")
    per = gains.filter(F.col("gain") >= least).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    start = F.array().cast("array<struct<g:double,role:string,champion:string>>")
    taken = lambda acc, x: F.exists(acc, lambda t: (t["role"] == x["role"]) | (t["champion"] == x["champion"]))
    fold = F.aggregate("c", start, lambda acc, x: F.when((F.size(acc) < top) & ~taken(acc, x), F.array_append(acc, x)).otherwise(acc))
    return per.select(*keys, F.posexplode(fold).alias("i", "x")).select(
        *keys, (F.col("i") + 1).alias("place"), "x.role", "x.champion", (-F.col("x.g")).alias("gain")
    )


def teams_by_league(teams: DataFrame, assignment: DataFrame) -> DataFrame:
    """Known teams with their league of the assignment, the rest under Other."""
    return teams.join(assignment, "team", "left").select(F.coalesce("league", F.lit("Other")).alias("league"), "team")


def series(games: DataFrame, series_key: str, order: str, winner: str, best_of: int = 5) -> DataFrame:
    """Running score of each series until one side has the majority. A series has at
    most ``best_of`` games, so its window is bounded."""
    w = Window.partitionBy(series_key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    need = best_of // 2 + 1
    d = games.withColumns(
        {"blue_wins": F.sum((F.col(winner) == "Blue").cast("int")).over(w), "red_wins": F.sum((F.col(winner) == "Red").cast("int")).over(w)}
    )
    blue_now, red_now = (F.col(winner) == "Blue").cast("int"), (F.col(winner) == "Red").cast("int")
    before = F.greatest(F.col("blue_wins") - blue_now, F.col("red_wins") - red_now)
    played = d.filter(before < need)
    return played.groupBy(series_key).agg(
        F.count("*").alias("games_played"), F.max("blue_wins").alias("blue_wins"), F.max("red_wins").alias("red_wins")
    ).withColumn(
        "series_winner", F.when(F.col("blue_wins") >= need, "Blue").when(F.col("red_wins") >= need, "Red").otherwise("open")
    )
