"""All swaps of a draft's side scored in the side's own row.

A swap changes one pick, and so only the features made from picks. The side's other
features are looked up once, not for each of its 25 swaps; the picks' values come from
tables of champions by role and by patch, which every task gets whole. The formulas are
those of ``FeatureModel``; ``tests/test_swaps.py`` holds both ways together.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.features import CANONICAL_48, CHAMPION_DEFAULTS, FeatureModel
from boutline.plans.bounded import within
from boutline.roles import ROLES, UNKNOWN

#: Values of a champion in a role, with the defaults of the feature model (None: of the training rows).
BY_ROLE = {c: CHAMPION_DEFAULTS.get(c) for c in ("win_rate", "early_game_strength", "late_game_strength", "scaling_factor", "flexibility", "lane_advantage", "lane_confidence")} | {"archetype_advantage": None, "encoded": None}
BY_PATCH = {"meta_strength": 0.5, "popularity": 0.0}
#: Numbers of all tables up to which they are sent to the tasks, and sides computed together.
MOST_NUMBERS = 2_000_000
CHUNK_SIDES = 512


class SwapTables:
    def __init__(self, features: FeatureModel, champions: list[str]):
        """Tables of ``features``; ``champions`` may be swapped in."""
        r = features.roles
        columns = list(r.champions)
        role_rows = features.role_champion.collect()
        encoded = features.encoders.filter(F.col("column_name").isin(columns)).select("column_name", "category", "encoded").collect()
        patch_rows = features.patch_champion.collect()
        self.names = sorted({UNKNOWN, *champions, *(x["champion"] for x in role_rows), *(x["category"] for x in encoded), *(x["champion"] for x in patch_rows)})
        self.patches = sorted({x[r.patch] for x in patch_rows})
        self.unknown = None if features.include_unknown else self.names.index(UNKNOWN) + 1
        at, patch_at = ({n: i + 1 for i, n in enumerate(names)} for names in (self.names, self.patches))  # 0: none of them
        prior = features.train.select(features.prior.alias("p")).first()["p"]
        balanced = features.balanced.first()["m"] or {}
        self.by_role = np.empty((5, len(at) + 1, len(BY_ROLE)))
        for i, role in enumerate(ROLES):
            other = balanced.get(role)
            defaults = {**BY_ROLE, "archetype_advantage": 0.5 if other is None else other, "encoded": prior}
            self.by_role[i] = [defaults[c] for c in BY_ROLE]
            self.by_role[i, at[UNKNOWN], list(BY_ROLE).index("archetype_advantage")] = 0.5
        for x in role_rows:
            for j, c in enumerate(BY_ROLE):
                if c != "encoded" and x[c] is not None:
                    self.by_role[ROLES.index(x["role"]), at[x["champion"]], j] = x[c]
        for x in encoded:
            if x["encoded"] is not None:
                self.by_role[columns.index(x["column_name"]), at[x["category"]], -1] = x["encoded"]
        self.by_patch = np.tile(np.array(list(BY_PATCH.values())), (len(patch_at) + 1, len(at) + 1, 1))
        for x in patch_rows:
            for j, c in enumerate(BY_PATCH):
                if x[c] is not None:
                    self.by_patch[patch_at[x[r.patch]], at[x["champion"]], j] = x[c]

    @staticmethod
    def of(features: FeatureModel, meta: DataFrame) -> SwapTables | None:
        """None if the tables are too large to be sent to every task."""
        features.prepare("role_champion", "encoders", "patch_champion", "balanced")
        champions = meta.select("champion").distinct()
        if not within(champions) or not all(features._fits(n) for n in ("role_champion", "encoders", "patch_champion")):
            return None
        found = features.role_champion.agg(F.count_distinct("champion")).first()[0] + champions.count()
        patches = features.patch_champion.agg(F.count_distinct(features.roles.patch)).first()[0]
        if found * (5 * len(BY_ROLE) + 2 * patches) > MOST_NUMBERS:
            return None
        return SwapTables(features, [x["champion"] for x in champions.collect()])

    def features(self, row: dict[str, np.ndarray], patch: np.ndarray, picks: np.ndarray) -> dict[str, np.ndarray]:
        """Features of ``picks`` (side, variant, role), places of champions; those that no
        pick touches are the side's own (``row``, a column each)."""
        x = dict(zip(BY_ROLE, np.moveaxis(self.by_role[np.arange(5), picks], -1, 0)))
        x |= dict(zip(BY_PATCH, np.moveaxis(self.by_patch[patch[:, None, None], picks], -1, 0)))
        known = np.ones(picks.shape, bool) if self.unknown is None else picks != self.unknown
        n = known.sum(axis=-1)
        mean = lambda c, default: np.where(n > 0, (x[c] * known).sum(axis=-1) / np.maximum(n, 1), default)
        spread = lambda c, m: np.where(n > 1, np.sqrt((((x[c] - m[..., None]) ** 2) * known).sum(axis=-1) / np.maximum(n - 1, 1)), 0.0)
        own = {c: v[:, None] for c, v in row.items()}
        lane, scaling, strength = x["lane_advantage"], mean("scaling_factor", 0.0), mean("meta_strength", 0.5)
        new = {
            "team_avg_winrate": mean("win_rate", 0.5), "team_early_strength": mean("early_game_strength", 0.5), "team_late_strength": mean("late_game_strength", 0.5),
            "team_scaling": scaling, "team_flexibility": mean("flexibility", 1.0), "composition_balance": spread("scaling_factor", scaling),
            "team_meta_strength": strength, "team_popularity": mean("popularity", 0.0), "team_meta_consistency": 1 - spread("meta_strength", strength),
            "meta_advantage": strength - 0.5, "champion_count": (picks != self.names.index(UNKNOWN) + 1).sum(axis=-1),
            "team_lane_advantage": lane.mean(axis=-1), "lane_advantage_consistency": 1 - lane.std(axis=-1, ddof=1), "lane_matchup_confidence": x["lane_confidence"].mean(axis=-1),
            "strongest_lane_advantage": lane.max(axis=-1), "weakest_lane_advantage": lane.min(axis=-1), "lanes_with_advantage": (lane > 0.55).sum(axis=-1),
            "team_archetype_advantage": x["archetype_advantage"].mean(axis=-1),
        }
        new |= {f"{p}_champion_target_encoded": x["encoded"][..., i] for i, p in enumerate(("top", "jng", "mid", "bot", "sup"))}
        new |= {
            "meta_form_interaction": strength * own["team_form_trend"], "scaling_experience_interaction": scaling * own["team_experience"],
            "lane_meta_synergy": new["team_lane_advantage"] * strength, "experience_matchup_confidence": own["team_experience"] * new["lane_matchup_confidence"],
            "scaling_lane_advantage": scaling * new["strongest_lane_advantage"],
        }
        return own | new


def _rounded(gain: np.ndarray) -> np.ndarray:
    """Tenths, halves away from 0 as the decimal digits have them, like Spark's round."""
    size = np.abs(gain) * 10
    out = np.floor(size + 0.5)
    for at in zip(*np.nonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(abs(gain[at])))).quantize(Decimal("0.1"), ROUND_HALF_UP) * 10)
    return (np.sign(gain) * out).astype(np.int64)


def greedy(tenths: np.ndarray, swap: np.ndarray, least: float, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(side, role, candidate) of each place: best first, then by name of role and champion, each
    role and champion once. ``tenths`` (side, role, candidate); ``swap``: the candidates' places, -1 for none."""
    sides, roles, most = tenths.shape
    role_order = np.argsort(np.argsort(ROLES))
    worth = tenths * (roles * (int(swap.max(initial=0)) + 2)) - (role_order[:, None] * (int(swap.max(initial=0)) + 2) + swap[:, None, :])
    free = (swap[:, None, :] >= 0) & (tenths >= np.ceil(least * 10 - 1e-9))
    for _ in range(top):
        open_ = np.flatnonzero(free.any(axis=(1, 2)))
        if not len(open_):
            return
        best = np.where(free[open_], worth[open_], np.iinfo(np.int64).min).reshape(len(open_), -1).argmax(axis=1)
        role, candidate = best // most, best % most
        yield open_, role, candidate
        free[open_, role, :] = False
        free[open_[:, None], :, :] &= (swap[open_] != swap[open_, candidate][:, None])[:, None, None, :]


def suggestions(rows: DataFrame, tables: SwapTables, coef: dict[str, float], champions: list[str], patch: str, least: float = 0.5, top: int = 5) -> DataFrame:
    """(draft_id, place, role, champion, gain, side) from sides (draft_id, side_name, swaps,
    champions, patch, the 48 features)."""
    names, patches = pa.array(tables.names), pa.array(tables.patches, pa.string())

    def place(column: pa.Array, of: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(column, value_set=of), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_SIDES):
                b = batch.slice(first, CHUNK_SIDES)
                base = np.stack([place(b.column(c), names) for c in champions], axis=1)
                lists = b.column("swaps")
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                most = int(lengths.max(initial=0))
                if not most:
                    continue
                swap = np.full((b.num_rows, most), -1)
                swap[np.arange(most) < lengths[:, None]] = place(lists.flatten(), names)
                picks = np.repeat(base[:, None, :], 1 + 5 * most, axis=1)
                for r in range(5):
                    picks[:, 1 + r * most : 1 + (r + 1) * most, r] = np.where(swap >= 0, swap, base[:, [r]])
                x = tables.features({c: b.column(c).to_numpy(zero_copy_only=False) for c in CANONICAL_48}, place(b.column(patch), patches), picks)
                z = np.full(picks.shape[:2], coef.get("intercept", 0.0))
                for c, v in coef.items():
                    if c != "intercept":
                        z = z + x[c] * v
                p = 1 / (1 + np.exp(-z))
                tenths = _rounded((p[:, 1:] - p[:, :1]) * 100).reshape(-1, 5, most)
                for k, (side, role, candidate) in enumerate(greedy(tenths, swap, least, top)):
                    at = pa.array(side)
                    yield pa.RecordBatch.from_arrays([
                        b.column("draft_id").take(at), pa.array(np.full(len(side), k + 1, np.int32)), pa.array(ROLES).take(pa.array(role)),
                        names.take(pa.array(swap[side, candidate] - 1)), pa.array(tenths[side, role, candidate] / 10.0), b.column("side_name").take(at),
                    ], ["draft_id", "place", "role", "champion", "gain", "side"])

    schema = f"draft_id {dict(rows.dtypes)['draft_id']}, place int, role string, champion string, gain double, side string"
    return rows.mapInArrow(run, schema)
