"""Batch scoring of drafts, pick impact and swap suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.evaluation.metrics import confidence
from boutline.ml.swaps import SwapTables, suggestions
from boutline.ml.training import predict
from boutline.operators import drafts as D
from boutline.operators.features import CANONICAL_48, FeatureModel
from boutline.roles import ROLE_PREFIX, ROLES

NEUTRAL = "__neutral__"


class DraftScorer:
    """A fitted feature model and a classifier over its 48 features: a fitted pipeline, or
    plain coefficients by feature (with an ``intercept``), applied as one expression."""

    def __init__(self, features: FeatureModel, model):
        self.features, self.model = features, model

    def score_rows(self, rows: DataFrame, keep: list[str], also: tuple[str, ...] = ()) -> DataFrame:
        """(keep..., also..., p) for match-like rows; all rows are one batch. ``also``
        names features to return."""
        v = self.features.vector(rows, "snapshot", ["row_id", *keep])
        if isinstance(self.model, dict):
            return weighted_features(v, self.model).select("row_id", *keep, *also, "p")
        return predict(self.model, v.withColumn("result", F.lit(0)), ["row_id", *keep, *also]).drop("y_true")

    def score(self, drafts: DataFrame) -> DataFrame:
        """One row per draft: both win probabilities, level, bounds, team form."""
        team = ("team_overall_winrate", "team_recent_winrate", "team_form_trend")
        s = self.score_rows(D.side_rows(drafts), ["draft_id", "side"], team)
        of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        g = s.groupBy("draft_id").agg(
            ((of("Blue", "p") + 1 - of("Red", "p")) / 2).alias("p"),
            *[of(side, c).alias(f"{side.lower()}_{c}") for side in ("Blue", "Red") for c in team],
        )
        return confidence(g).withColumnsRenamed({"p": "blue_win_prob"}).withColumn("red_win_prob", 1 - F.col("blue_win_prob"))

    def checked(self, drafts: DataFrame, champions: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(scores of the valid drafts, errors of the others)."""
        errors = D.validate(drafts, champions, teams)
        return self.score(drafts.join(errors.select("draft_id").distinct(), "draft_id", "left_anti")), errors

    def pick_impact(self, drafts: DataFrame) -> DataFrame:
        """(draft_id, side, role, champion, impact_pct): the probability of the side
        minus that with the role's champion made neutral. Six rows per side."""
        rows = D.side_rows(drafts)
        champs = [f"{p}_champion" for p in ROLE_PREFIX]
        variants = F.array(F.lit("none"), *[F.lit(r) for r in ROLES])
        v = rows.withColumn("champion_map", F.create_map(*[x for r, c in zip(ROLES, champs) for x in (F.lit(r), F.col(c))]))
        v = v.withColumn("variant", F.explode(variants))
        v = v.withColumns({c: F.when(F.col("variant") == r, F.lit(NEUTRAL)).otherwise(F.col(c)) for r, c in zip(ROLES, champs)})
        v = v.withColumns({"champion": F.element_at("champion_map", F.col("variant")), "base_row": F.col("row_id")})
        v = v.withColumn("row_id", F.col("row_id") * 6 + F.array_position(variants, F.col("variant")) - 1).drop("champion_map")
        v = v.repartition("draft_id", "side")  # rows are six times the drafts here, which few tasks hold
        s = self.score_rows(v, ["base_row", "draft_id", "side", "variant", "champion"])
        base = F.max(F.when(F.col("variant") == "none", F.col("p")))
        item = F.struct(F.col("variant").alias("role"), "champion", "p")
        per = s.groupBy("draft_id", "side").agg(base.alias("b"), F.collect_list(F.when(F.col("variant") != "none", item)).alias("xs"))  # five items
        return per.select("draft_id", "side", "b", F.explode("xs").alias("x")).select(
            "draft_id", "side", "x.role", "x.champion", F.round((F.col("b") - F.col("x.p")) * 100, 1).alias("impact_pct")
        )

    def both_suggestions(self, drafts: DataFrame, meta: DataFrame) -> DataFrame:
        """Suggestions for each side of every draft, from one batch of scores."""
        return self._suggestions(drafts, meta, ("blue", "red"))

    def suggestions(self, drafts: DataFrame, meta: DataFrame, side: str = "blue") -> DataFrame:
        """Up to five swaps per draft: candidates, one batch of scores, greedy pick."""
        return self._suggestions(drafts, meta, (side,)).drop("side")

    def _suggestions(self, drafts: DataFrame, meta: DataFrame, sides: tuple[str, ...]) -> DataFrame:
        """The draft as it is (no swap role) and its 25 swaps, 26 rows a side, scored
        together. They are dealt over tasks before features are looked up: drafts alone
        are so small that a task or two would get them all. A linear model scores the swaps
        in the side's row instead (``ml/swaps.py``), if its tables may be sent to the tasks."""
        tables = SwapTables.of(self.features, meta) if isinstance(self.model, dict) else None
        if tables is not None:
            return self._swaps_in_place(drafts, meta, sides, tables)
        rows = D.side_rows(drafts).withColumn("side_name", F.lower("side")).filter(F.col("side_name").isin(*sides))
        cand = D.swap_candidates(drafts, meta).select("draft_id", F.col("role").alias("swap_role"), "champion", "place")
        as_is = drafts.select("draft_id", *[F.lit(None).cast(t).alias(c) for c, t in cand.dtypes[1:]])
        v = rows.join(cand.unionByName(as_is), "draft_id").repartition("draft_id", "side_name")
        swap = {f"{p}_champion": F.when(F.col("swap_role") == r, F.col("champion")).otherwise(F.col(f"{p}_champion")) for p, r in zip(ROLE_PREFIX, ROLES)}
        at = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("swap_role"))
        v = v.withColumns(swap).withColumn("row_id", F.col("row_id") * 32 + F.coalesce((at - 1) * 5 + F.col("place"), F.lit(0)))
        s = self.score_rows(v, ["draft_id", "side_name", "swap_role", "champion"])
        item = F.struct(F.col("swap_role").alias("role"), "champion", "p")
        per = s.groupBy("draft_id", "side_name").agg(
            F.max(F.when(F.col("swap_role").isNull(), F.col("p"))).alias("p_now"), F.collect_list(F.when(F.col("swap_role").isNotNull(), item)).alias("xs")
        )  # 25 items
        gains = per.select("draft_id", F.col("side_name").alias("side"), "p_now", F.explode("xs").alias("x"))
        gains = gains.select("draft_id", "side", "x.role", "x.champion", F.round((F.col("x.p") - F.col("p_now")) * 100, 1).alias("gain"))
        return D.resolve_suggestions(gains, keys=("draft_id", "side")).select("draft_id", "place", "role", "champion", "gain", "side")

    def _swaps_in_place(self, drafts: DataFrame, meta: DataFrame, sides: tuple[str, ...], tables: SwapTables) -> DataFrame:
        """No row is multiplied or moved: a side's features are looked up once."""
        r = self.features.roles
        swaps = D.with_swaps(drafts, meta).withColumn("swaps", F.transform("swaps", lambda x: x["champion"]))
        rows = D.side_rows(swaps).withColumn("side_name", F.lower("side")).filter(F.col("side_name").isin(*sides))
        v = self.features.vector(rows, "snapshot", ["draft_id", "side_name", "swaps", *r.champions, r.patch])
        return suggestions(v, tables, self.model, list(r.champions), r.patch)


def weighted_features(df: DataFrame, coef: dict[str, float]) -> DataFrame:
    """A linear score as a column expression, for models kept as plain numbers."""
    z = reduce(lambda a, b: a + b, [F.col(c) * v for c, v in coef.items() if c != "intercept"], F.lit(coef.get("intercept", 0.0)))
    return df.withColumn("p", 1 / (1 + F.exp(-z)))


__all__ = ["DraftScorer", "weighted_features", "CANONICAL_48", "NEUTRAL"]
