"""Feature vectors assembled from lookups and histories.

``FeatureModel.fit(train)`` holds lookups computed from the training rows only;
``transform`` applies them to any rows, also to drafts. The same expressions
serve batch rows and drafts, so both agree exactly.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.scalar import patch_part, row_mean, row_std
from boutline.operators import encoding, form, lookups
from boutline.plans.bounded import BROADCAST_ROWS, bounded, within
from boutline.plans.ordered import HOT_ROWS, Past, history, hot_keys, time_levels
from boutline.roles import MATCH, NO_BAN, ROLE_PREFIX, ROLES, UNKNOWN, Roles
from boutline.session import cut_lineage

# The 48 features in the order a scaler expects.
CANONICAL_48 = (
    "team_avg_winrate", "team_early_strength", "team_late_strength", "team_scaling", "team_flexibility",
    "composition_balance", "team_meta_strength", "team_meta_consistency", "team_popularity", "meta_advantage",
    "ban_count", "ban_diversity", "high_priority_bans", "team_overall_winrate", "team_recent_winrate",
    "team_form_trend", "team_experience", "composition_historical_winrate", "playoffs", "side_blue", "year",
    "champion_count", "meta_form_interaction", "scaling_experience_interaction", "team_lane_advantage",
    "lane_advantage_consistency", "lane_matchup_confidence", "strongest_lane_advantage", "weakest_lane_advantage",
    "lanes_with_advantage", "team_archetype_advantage", "team_historical_advantage", "team_matchup_consistency",
    "favorable_matchups", "unfavorable_matchups", "lane_meta_synergy", "experience_matchup_confidence",
    "form_matchup_interaction", "scaling_lane_advantage", "league_target_encoded", "team_target_encoded",
    "patch_target_encoded", "split_target_encoded", "top_champion_target_encoded", "jng_champion_target_encoded",
    "mid_champion_target_encoded", "bot_champion_target_encoded", "sup_champion_target_encoded",
)
# The seven player features that follow them.
PLAYER_7 = (
    "team_avg_player_winrate", "team_avg_player_recent", "team_avg_player_experience", "team_avg_champion_mastery",
    "team_min_champion_mastery", "team_player_form", "player_mastery_experience_interaction",
)
CANONICAL_55 = CANONICAL_48 + PLAYER_7

# Defaults of lookups that miss.
CHAMPION_DEFAULTS = {
    "win_rate": 0.5, "early_game_strength": 0.5, "late_game_strength": 0.5, "scaling_factor": 0.0, "flexibility": 1.0,
    "lane_advantage": 0.5, "lane_confidence": 0.1, "archetype_advantage": 0.5,
}


def role_lookup(
    df: DataFrame, lookup: DataFrame, extra: list[str], values: dict[str, float | None], by_role: bool = False,
    roles: Roles = MATCH, max_rows: int = BROADCAST_ROWS, fits: bool | None = None,
) -> DataFrame:
    """Adds <value>_<i> for the champion of each role i, by (extra, [role], champion).

    A lookup within the size bound is broadcast: five hash probes, no shuffle of
    the rows. A larger one is joined once on unpivoted rows and folded back.
    ``fits`` tells whether it is within the bound, if that is known already.
    """
    names = list(values)
    if within(lookup, max_rows) if fits is None else fits:
        out = df
        for i, (role, c) in enumerate(zip(ROLES, roles.champions)):
            part = lookup.filter(F.col("role") == role) if by_role else lookup
            part = part.select(*[F.col(k).alias(f"__x_{k}") for k in extra], F.col("champion").alias("__xc"), *[F.col(v).alias(f"{v}_{i}") for v in names])
            on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__x_{k}") for k in extra], F.col(c) == F.col("__xc"))
            out = out.join(F.broadcast(part), on, "left").drop("__xc", *[f"__x_{k}" for k in extra])
        return out.withColumns({f"{v}_{i}": F.coalesce(f"{v}_{i}", F.lit(d)) for v, d in values.items() for i in range(5) if d is not None})
    long = df.select(
        roles.row, *extra,
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.col(c).alias("champion")) for i, (r, c) in enumerate(zip(ROLES, roles.champions))])).alias("x"),
    ).select(roles.row, *extra, "x.*")
    keys = [*extra, "champion", *(["role"] if by_role else [])]
    hit = long.join(lookup.select(*keys, *names), keys, "left")
    folded = hit.groupBy(roles.row).agg(*[F.max(F.when(F.col("i") == i, F.col(v))).alias(f"{v}_{i}") for v in names for i in range(5)])
    out = df.join(folded, roles.row, "left")
    return out.withColumns({f"{v}_{i}": F.coalesce(f"{v}_{i}", F.lit(d)) for v, d in values.items() for i in range(5) if d is not None})


#: Columns that tell which picks count, and how many; made once for all means of a row.
_FLAGS = [f"__known_{i}" for i in range(5)]


def _known(df: DataFrame, roles: Roles, include_unknown: bool) -> DataFrame:
    if _FLAGS[0] in df.columns:
        return df
    one = lambda c: F.lit(1) if include_unknown else (F.coalesce(F.col(c), F.lit(UNKNOWN)) != UNKNOWN).cast("int")
    out = df.withColumns(dict(zip(_FLAGS, map(one, roles.champions))))
    return out.withColumn("__known", _sum([F.col(f) for f in _FLAGS]))


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _mean_of(name: str, default: float) -> Column:
    s = _sum([F.when(F.col(f) == 1, c).otherwise(F.lit(0.0)) for c, f in zip(_cols(name), _FLAGS)])
    return F.when(F.col("__known") > 0, s / F.col("__known")).otherwise(F.lit(default))


def _std_of(name: str, mean: str) -> Column:
    """Sample deviation of the known picks' values around the column ``mean``, a column
    of its own: as an expression it would be evaluated again for each pick."""
    ss = _sum([F.when(F.col(f) == 1, (c - F.col(mean)) * (c - F.col(mean))).otherwise(F.lit(0.0)) for c, f in zip(_cols(name), _FLAGS)])
    return F.when(F.col("__known") > 1, F.sqrt(ss / (F.col("__known") - 1))).otherwise(F.lit(0.0))


def _cols(name: str) -> list[Column]:
    return [F.col(f"{name}_{i}") for i in range(5)]


def _without(df: DataFrame, names) -> DataFrame:
    return df.drop(*[f"{n}_{i}" for n in names for i in range(5)])


def _apart(df: DataFrame) -> DataFrame:
    """The same rows in the same tasks. Spark makes one Java method of neighbouring joins
    and projections, and Java does not compile a method of more than 8,000 bytes: all
    feature groups in one would be interpreted. A coalesce to no fewer tasks moves nothing
    and ends the method."""
    return df.coalesce(1 << 20)


class FeatureModel:
    """Lookups of one training set. Each is computed on first use and then kept as a
    table in the shared folder, because several joins and a size check read it."""

    def __init__(self, train: DataFrame, roles: Roles = MATCH, include_unknown: bool = False, hot_rows: int | None = HOT_ROWS):
        self.train, self.roles = train, roles
        self.include_unknown, self.hot_rows = include_unknown, hot_rows
        self._within: dict[str, bool] = {}

    @classmethod
    def fit(cls, train: DataFrame, **kw) -> "FeatureModel":
        return cls(train, **kw)

    def prepare(self, *names: str) -> "FeatureModel":
        """Compute lookups side by side: they are independent jobs, each too short
        to fill a cluster."""
        todo = [n for n in names or ("role_champion", "snapshot", "encoders", "teams", "patch_champion", "balanced") if n not in self.__dict__]
        if todo:
            self.characteristics  # two of the others read it
        with ThreadPoolExecutor(max(len(todo), 1)) as pool:
            list(pool.map(self._fits, todo))
        return self

    def _fits(self, name: str) -> bool:
        """Whether the lookup may be broadcast; counted once."""
        if name not in self._within:
            self._within[name] = within(getattr(self, name))
        return self._within[name]

    def _hinted(self, name: str) -> DataFrame:
        return F.broadcast(getattr(self, name)) if self._fits(name) else getattr(self, name)

    @cached_property
    def encoder_columns(self) -> list[str]:
        r = self.roles
        return [r.league, r.entity, r.patch, r.split, *r.champions]

    @cached_property
    def encoders(self) -> DataFrame:
        return cut_lineage(encoding.fit_target_encoding(self.train, self.encoder_columns, self.roles))

    @cached_property
    def prior(self) -> Column:
        y = F.col(self.roles.outcome)
        return self.train.agg(F.sum(y) / F.count(y)).scalar()

    @cached_property
    def characteristics(self) -> DataFrame:
        return cut_lineage(lookups.champion_characteristics(self.train, self.roles))

    @cached_property
    def role_champion(self) -> DataFrame:
        """(role, champion) -> characteristics, lane and archetype advantages."""
        chars = self.characteristics.drop("games", "wins", "primary_position")
        lane = lookups.lane_summary(self.train, self.roles, lookups.champion_archetypes(self.characteristics))  # champions x five roles
        return cut_lineage(lane.join(chars, "champion", "left").withColumn("flexibility", F.col("flexibility").cast("double")))

    @cached_property
    def patch_champion(self) -> DataFrame:
        return cut_lineage(lookups.meta_indicators(self.train, self.roles).select(self.roles.patch, "champion", "meta_strength", "popularity"))

    @cached_property
    def priority_bans(self) -> DataFrame:
        """One row: the champions banned early more than half of the time. Bounded
        by the number of champions."""
        return lookups.ban_priority(self.train, self.roles).filter("high_priority").agg(F.collect_set("champion").alias("c"))

    @cached_property
    def compositions(self) -> DataFrame:
        return cut_lineage(lookups.composition_rates(self.train, self.roles).select("signature", F.col("win_rate").alias("composition_historical_winrate")))

    @cached_property
    def teams(self) -> DataFrame:
        return cut_lineage(lookups.peer_summary(self.train, self.roles))

    @cached_property
    def snapshot(self) -> DataFrame:
        return cut_lineage(form.latest_form(self.train, self.roles))

    @cached_property
    def shifts(self) -> DataFrame:
        return cut_lineage(form.patch_shift(self.train, self.roles))

    # -- feature groups -----------------------------------------------------

    def composition(self, df: DataFrame) -> DataFrame:
        values = {v: CHAMPION_DEFAULTS[v] for v in ("win_rate", "early_game_strength", "late_game_strength", "scaling_factor", "flexibility")}
        out = role_lookup(_known(df, self.roles, self.include_unknown), self.role_champion, [], values, True, self.roles, fits=self._fits("role_champion"))
        out = out.withColumns(
            {
                "team_avg_winrate": _mean_of("win_rate", 0.5),
                "team_early_strength": _mean_of("early_game_strength", 0.5),
                "team_late_strength": _mean_of("late_game_strength", 0.5),
                "team_scaling": _mean_of("scaling_factor", 0.0),
                "team_flexibility": _mean_of("flexibility", 1.0),
            }
        )
        out = out.withColumn("composition_balance", _std_of("scaling_factor", "team_scaling"))
        return _without(out, values).drop(*([] if _FLAGS[0] in df.columns else [*_FLAGS, "__known"]))

    def meta(self, df: DataFrame) -> DataFrame:
        r = self.roles
        out = role_lookup(df, self.patch_champion, [r.patch], {"meta_strength": 0.5, "popularity": 0.0}, False, r, fits=self._fits("patch_champion"))
        out = _known(out, r, self.include_unknown).withColumns({"team_meta_strength": _mean_of("meta_strength", 0.5), "team_popularity": _mean_of("popularity", 0.0)})
        out = out.withColumns({"team_meta_consistency": 1 - _std_of("meta_strength", "team_meta_strength"), "meta_advantage": F.col("team_meta_strength") - 0.5})
        return _without(out, ("meta_strength", "popularity")).drop(*([] if _FLAGS[0] in df.columns else [*_FLAGS, "__known"]))

    def bans(self, df: DataFrame) -> DataFrame:
        named = [f"__ban_{i}" for i in range(len(self.roles.bans))]
        out = df.withColumns({n: F.when((F.col(b) != NO_BAN) & (F.col(b) != ""), F.col(b)) for n, b in zip(named, self.roles.bans)})
        out = out.withColumn("__high", self.priority_bans.scalar())
        valid = [F.col(n) for n in named]
        fresh = [reduce(lambda a, b: a & b, [~v.eqNullSafe(w) for w in valid[:i]], v.isNotNull()) for i, v in enumerate(valid)]
        high = [F.coalesce(F.array_contains(F.col("__high"), v), F.lit(False)) for v in valid]
        count = lambda flags: _sum([f.cast("int") for f in flags])
        out = out.withColumns({"ban_count": count([v.isNotNull() for v in valid]), "ban_diversity": count(fresh), "high_priority_bans": count(high)})
        return out.drop("__high", *named)

    def past(self, df: DataFrame, past: str, hot: bool | None = None) -> DataFrame:
        """Team history: of the row itself (training rows) or the training
        snapshot of its team (all later rows). ``hot=False`` states that no team has
        more than ``hot_rows`` rows."""
        if past == "rows":
            out = form.entity_form(df, self.roles, None if hot is False else self.hot_rows)
            keep = [*df.columns, "games_played", "overall_winrate", "recent_winrate", "form_trend"]
            out = out.select(*keep)
        else:
            out = df.join(self._hinted("snapshot").drop("current_streak"), self.roles.entity, "left")
        games = F.coalesce("games_played", F.lit(0))
        return out.withColumns(
            {
                "team_overall_winrate": F.coalesce("overall_winrate", F.lit(0.5)),
                "team_recent_winrate": F.coalesce("recent_winrate", F.lit(0.5)),
                "team_form_trend": F.coalesce("form_trend", F.lit(0.0)),
                "team_experience": F.least(games / 100, F.lit(1.0)),
            }
        ).drop("games_played", "overall_winrate", "recent_winrate", "form_trend")

    def context(self, df: DataFrame) -> DataFrame:
        r = self.roles
        n = _sum([(F.coalesce(F.col(c), F.lit(UNKNOWN)) != UNKNOWN).cast("int") for c in r.champions])
        return df.withColumns(
            {
                "playoffs": (F.col(r.playoffs) == 1).cast("int"),
                "side_blue": (F.coalesce(F.col(r.side), F.lit("Blue")) == "Blue").cast("int"),
                "champion_count": n,
            }
        )

    @cached_property
    def balanced(self) -> DataFrame:
        """One row: role -> mean advantage of the Balanced archetype, which stands
        in for champions the training rows never saw."""
        arch = lookups.champion_archetypes(self.characteristics)
        m = lookups.archetype_matchups(self.train, arch, self.roles).filter("archetype = 'Balanced'").groupBy("role").agg(F.avg("advantage").alias("v"))
        return cut_lineage(m.agg(F.map_from_entries(F.collect_list(F.struct("role", "v"))).alias("m")))

    def lanes(self, df: DataFrame) -> DataFrame:
        values = {"lane_advantage": CHAMPION_DEFAULTS["lane_advantage"], "lane_confidence": CHAMPION_DEFAULTS["lane_confidence"], "archetype_advantage": None}
        out = role_lookup(df, self.role_champion, [], values, True, self.roles, fits=self._fits("role_champion"))
        out = out.withColumn("__other", self.balanced.scalar())
        unseen = [
            F.when(F.coalesce(F.col(c), F.lit(UNKNOWN)) == UNKNOWN, 0.5).otherwise(F.coalesce(F.element_at("__other", F.lit(r)), F.lit(0.5)))
            for c, r in zip(self.roles.champions, ROLES)
        ]
        out = out.withColumns({f"archetype_advantage_{i}": F.coalesce(f"archetype_advantage_{i}", u) for i, u in enumerate(unseen)}).drop("__other")
        a = _cols("lane_advantage")
        out = out.withColumns(
            {
                "team_lane_advantage": row_mean(a),
                "lane_advantage_consistency": 1 - row_std(a),
                "lane_matchup_confidence": row_mean(_cols("lane_confidence")),
                "strongest_lane_advantage": F.greatest(*a),
                "weakest_lane_advantage": F.least(*a),
                "lanes_with_advantage": reduce(lambda x, y: x + y, [(c > 0.55).cast("int") for c in a]),
                "team_archetype_advantage": row_mean(_cols("archetype_advantage")),
            }
        )
        return _without(out, values)

    def peers(self, df: DataFrame) -> DataFrame:
        defaults = {"team_historical_advantage": 0.5, "team_matchup_consistency": 1.0, "favorable_matchups": 0, "unfavorable_matchups": 0}
        out = df.join(self._hinted("teams"), self.roles.entity, "left")
        return out.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in defaults.items()})

    def composition_rate(self, df: DataFrame) -> DataFrame:
        """Win rate of the exact composition in the training rows, else 0.5."""
        out = df.withColumn("signature", lookups.signature(self.roles))
        out = out.join(self._hinted("compositions"), "signature", "left").drop("signature")
        return out.withColumn("composition_historical_winrate", F.coalesce("composition_historical_winrate", F.lit(0.5)))

    def encode(self, df: DataFrame) -> DataFrame:
        enc = self.encoders
        hint = F.broadcast if self._fits("encoders") else (lambda d: d)
        cols = self.encoder_columns
        out = df
        for c in cols:
            e = hint(enc.filter(F.col("column_name") == c).select(F.col("category").alias("__k"), F.col("encoded").alias(f"__e_{c}")))
            out = out.join(e, F.col(c) == F.col("__k"), "left").drop("__k")
        out = out.withColumns({f"{self._encoded_name(c)}": F.coalesce(F.col(f"__e_{c}"), self.prior) for c in cols})
        return out.drop(*[f"__e_{c}" for c in cols])

    def _encoded_name(self, c: str) -> str:
        return "split_target_encoded" if c == self.roles.split else f"{c}_target_encoded"

    @staticmethod
    def interactions(df: DataFrame) -> DataFrame:
        pairs = {
            "meta_form_interaction": ("team_meta_strength", "team_form_trend"),
            "scaling_experience_interaction": ("team_scaling", "team_experience"),
            "lane_meta_synergy": ("team_lane_advantage", "team_meta_strength"),
            "experience_matchup_confidence": ("team_experience", "lane_matchup_confidence"),
            "form_matchup_interaction": ("team_form_trend", "team_historical_advantage"),
            "scaling_lane_advantage": ("team_scaling", "strongest_lane_advantage"),
        }
        return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in pairs.items()})

    # -- whole vectors ------------------------------------------------------

    def transform(self, df: DataFrame, past: str = "snapshot", composition: str = "default") -> DataFrame:
        """The 48 features. ``composition='fitted'`` looks compositions up; the
        default is the constant 0.5 used by models trained without it."""
        lookups_used = ("role_champion", "encoders", "teams", "patch_champion", "balanced")
        self.prepare(*lookups_used, *(() if past == "rows" else ("snapshot",)))
        # Teams may be few, and their history then runs in few tasks. So the lookups come
        # before its shuffle, in as many tasks as the rows have, unless a hot team splits it.
        last = past == "rows" and hot_keys(df, [self.roles.entity], self.hot_rows) is None
        out = _apart(_known(df if last else self.past(df, past), self.roles, self.include_unknown))
        for step in (self.meta, self.composition):
            out = _apart(step(out))
        for step in (self.lanes, self.bans, self.encode):
            out = _apart(step(out.drop(*_FLAGS, "__known")))
        out = self.peers(self.context(out))
        out = self.composition_rate(out) if composition == "fitted" else out.withColumn("composition_historical_winrate", F.lit(0.5))
        return self.interactions(self.past(out, past, False) if last else out)

    def vector(self, df: DataFrame, past: str = "snapshot", keep: list[str] | None = None, **kw) -> DataFrame:
        """Key columns, then the canonical features as doubles in their order."""
        keep = [self.roles.row] if keep is None else keep
        out = self.transform(df, past, **kw)
        return out.select(*keep, *[F.col(c).cast("double").alias(c) for c in CANONICAL_48])

    def vector_with_players(self, df: DataFrame, past: str = "rows", keep: list[str] | None = None) -> DataFrame:
        """48 + 7. Per-row player history (training rows) or training totals."""
        keep = [self.roles.row] if keep is None else keep
        base = self.vector(df, past, list(dict.fromkeys([self.roles.row, *keep])))
        pf = form.player_features(df, self.roles, self.hot_rows) if past == "rows" else self.player_snapshot(df)
        return base.join(pf, self.roles.row).select(*keep, *[F.col(c).cast("double").alias(c) for c in CANONICAL_55])

    def player_snapshot(self, df: DataFrame) -> DataFrame:
        """Player features of rows after training, from the training rows' totals
        and each player's last ten training outcomes."""
        r = self.roles
        pc = form.latest_player(self.train, r)
        p = pc.groupBy("player").agg(F.first("player_games").alias("player_games"), F.first("player_winrate").alias("player_winrate"))
        recent = self._player_recent
        long = form.role_long(df, r, [r.row], players=True, unknown=True)
        j = (
            long.join(p, "player", "left").join(recent, "player", "left")
            .join(pc.select("player", "champion", "champion_mastery"), ["player", "champion"], "left")
            .select(
                r.row, F.coalesce("player_winrate", F.lit(0.5)).alias("w"), F.coalesce("player_recent", F.lit(0.5)).alias("c"),
                F.coalesce("player_games", F.lit(0)).alias("g"), F.coalesce("champion_mastery", F.lit(0.5)).alias("m"),
            )
        )
        out = j.groupBy(r.row).agg(
            F.avg("w").alias("team_avg_player_winrate"), F.avg("c").alias("team_avg_player_recent"),
            F.avg(F.least(F.col("g") / 100, F.lit(1.0))).alias("team_avg_player_experience"),
            F.avg("m").alias("team_avg_champion_mastery"), F.min("m").alias("team_min_champion_mastery"),
            F.avg(F.col("c") - F.col("w")).alias("team_player_form"),
        )
        return out.withColumn("player_mastery_experience_interaction", F.col("team_avg_champion_mastery") * F.col("team_avg_player_experience"))

    @cached_property
    def _player_recent(self) -> DataFrame:
        """Mean of each player's last ten outcomes, read at the player's last row."""
        r = self.roles
        long = form.role_long(self.train, r, [r.row, r.time, r.outcome], players=True, unknown=True).filter(F.col("player") != UNKNOWN)
        y = F.col(r.outcome)
        frames = {"__s": (F.sum, y, 9), "__c": (F.count, y, 9)}
        h = history(long, ["player"], [Past(["player"], "__n", frames=frames)], [r.time, r.row], time_levels(long, r.time, r.row), self.hot_rows)
        recent = (F.coalesce("__s", F.lit(0)) + y) / (F.col("__c") + 1)
        return cut_lineage(h.groupBy("player").agg(F.max_by(recent, F.struct(r.time, r.row)).alias("player_recent")))

    def enhanced(self, df: DataFrame, past: str = "rows") -> DataFrame:
        """The larger set: momentum, patch shift, side, patch use, league record and
        the extended interactions, all rates from the training rows."""
        r = self.roles
        out = self.transform(form.patch_use(df, r, self.hot_rows) if past == "rows" else df, past)
        out = out.join(F.broadcast(self.shifts.select(r.patch, "patch_stability", "meta_shift_magnitude", "pick_shift_magnitude", "patch_games_count")), r.patch, "left")
        out = out.join(bounded(cut_lineage(lookups.side_rates(self.train, r))), r.entity, "left")
        out = out.join(lookups.patch_rates(self.train, r).drop("patch_games"), [r.entity, r.patch], "left")
        out = out.join(lookups.league_rates(self.train, r), [r.entity, r.league], "left")
        fill = {
            "blue_side_winrate": 0.5, "red_side_winrate": 0.5, "side_preference": 0.0, "patch_win_rate": 0.5, "patch_adaptation_rate": 0.0,
            "league_specific_winrate": 0.5, "league_dominance": 0.0, "cross_league_experience": 0.2, "patch_stability": 1.0,
            "meta_shift_magnitude": 0.0, "pick_shift_magnitude": 0.0, "patch_games_count": 0,
        }
        out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
        cur = F.when(F.col("side_blue") == 1, F.col("blue_side_winrate")).otherwise(F.col("red_side_winrate"))
        momentum = F.coalesce("form_momentum_short", F.lit(0.0)) if "form_momentum_short" in out.columns else F.lit(0.0)
        return out.withColumns(
            {
                "current_side_advantage": cur,
                "side_meta_interaction": cur * F.col("team_meta_strength"),
                "meta_side_synergy": F.col("team_meta_strength") * cur,
                "experience_adaptation_interaction": F.col("team_experience") * (F.col("patch_adaptation_rate") + 0.5),
                "form_matchup_synergy": F.col("team_recent_winrate") * F.col("team_historical_advantage"),
                "composition_aggression": F.col("team_early_strength") - F.col("team_late_strength"),
                "strategic_meta_interaction": F.col("ban_diversity") / 5 * F.col("team_meta_strength"),
                "confidence_weighted_meta": F.col("team_meta_strength") * F.col("lane_matchup_confidence"),
                "momentum_experience_synergy": momentum * F.col("team_experience"),
                "h2h_momentum": F.col("league_specific_winrate") * F.col("team_recent_winrate"),
            }
        )


def scale_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation per column, from training rows."""
    return df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])


def scale_apply(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / deviation; a constant column is only centred."""
    stats = fitted.select(F.struct("*")).scalar()
    out = df.withColumn("__s", stats)

    def z(c):
        m, sd = F.col(f"__s.m_{c}"), F.col(f"__s.s_{c}")
        return (F.col(c) - m) / F.when(sd > 0, sd).otherwise(F.lit(1.0))

    return out.withColumns({c: z(c) for c in columns}).drop("__s")


def static_features(df: DataFrame, classes: dict[str, list[str]], roles: Roles = MATCH) -> DataFrame:
    """Draft-only features: patch parts, size of the overlap of the picks with each
    champion class, distinct bans, balance of the classes."""
    picks = F.array(*[F.col(c) for c in roles.champions])
    counts = {f"{n}_count": F.size(F.array_intersect(picks, F.array(*[F.lit(c) for c in cs]))) for n, cs in classes.items()}
    out = df.select(
        roles.row, patch_part(roles.patch, 0).alias("patch_major"), patch_part(roles.patch, 1).alias("patch_minor"),
        *[c.alias(n) for n, c in counts.items()],
    )
    cs = [F.col(n) for n in counts]
    return out.withColumn("class_balance", F.greatest(*cs) - F.least(*cs) if len(cs) > 1 else F.lit(0))


def one_hot(df: DataFrame, columns: list[str], roles: Roles = MATCH):
    """Sparse indicators of the categories, by Spark ML (fit on df)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    idx = StringIndexer(inputCols=columns, outputCols=[f"__i_{c}" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"__i_{c}" for c in columns], outputCols=[f"__h_{c}" for c in columns], dropLast=False)
    asm = VectorAssembler(inputCols=[f"__h_{c}" for c in columns], outputCol="indicators")
    return Pipeline(stages=[idx, hot, asm]).fit(df)


def indicator_pairs(df: DataFrame, roles: Roles = MATCH) -> DataFrame:
    """Long form of the indicators: (row, indicator) for role_champion, ban, league."""
    items = [F.concat(F.lit(f"{p}_"), F.col(c)) for p, c in zip(ROLE_PREFIX, roles.champions)]
    items += [F.concat(F.lit("ban_"), F.col(b)) for b in roles.bans] + [F.concat(F.lit("league_"), F.col(roles.league))]
    return df.select(roles.row, F.explode(F.array_distinct(F.array(*items))).alias("indicator"))


# Name patterns of the feature categories; a feature may be in several.
CATEGORIES = {
    "champion_characteristics": r"team_avg|team_scaling", "meta_features": r"(?i)meta", "team_performance": r"team_.*(?i:winrate)|(?i:winrate).*team_",
    "side_features": r"(?i)side", "patch_features": r"(?i)patch", "interaction_features": r"(?i)interaction|synergy", "matchup_features": r"(?i)matchup|advantage|h2h",
}


def feature_categories(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """(feature, category) over the given column names, a row for each category that a
    name belongs to: metadata only."""
    found = F.array(*[F.when(F.col("feature").rlike(p), F.lit(n)) for n, p in CATEGORIES.items()])
    t = df.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    return t.select("feature", F.explode(F.array_compact(found)).alias("category"))


def balanced_subset(df: DataFrame, patterns: list[str], keep: list[str]) -> DataFrame:
    """Feature-set variants: columns whose names match any of the patterns."""
    import re

    cols = [c for c in df.columns if c not in keep and any(re.search(p, c) for p in patterns)]
    return df.select(*keep, *cols)
