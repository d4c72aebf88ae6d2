"""Swaps scored in a side's row are those of rows multiplied by their swaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutline import fixtures as fx
from boutline.ml import scoring, swaps
from boutline.operators import lookups
from boutline.operators.features import CANONICAL_48, FeatureModel
from boutline.session import cut_lineage


@pytest.mark.parametrize("include_unknown", [False, True])
def test_swaps_in_place_are_those_of_multiplied_rows(spark, sf, monkeypatch, include_unknown):
    wide = cut_lineage(fx.wide(spark, sf))
    train = wide.filter("year < 1996 AND top_champion <> 'C7' AND NOT (mid_champion = 'C9' AND patch = '3.1')")  # champions and patches that training lacks
    rng = np.random.default_rng(3)
    model = {c: float(v) for c, v in zip(CANONICAL_48, rng.normal(size=48))} | {"intercept": -0.3, "year": 0.0}
    s = scoring.DraftScorer(FeatureModel.fit(train, include_unknown=include_unknown), model)
    drafts, meta = cut_lineage(fx.drafts(spark, sf).limit(150)), cut_lineage(lookups.meta_indicators(wide).filter("patch <> '4.5'"))
    seen, own = [], scoring.suggestions
    monkeypatch.setattr(scoring, "suggestions", lambda rows, *a: seen.append(rows) or own(rows, *a))
    fast = s.both_suggestions(drafts, meta)
    assert seen[0].count() == 300  # a row a side
    monkeypatch.setattr(swaps.SwapTables, "of", staticmethod(lambda *a: None))
    slow = s.both_suggestions(drafts, meta)
    assert [t.split("(")[0] for _, t in fast.dtypes] == [t.split("(")[0] for _, t in slow.dtypes] and fast.columns == slow.columns
    got, want = ({tuple(r) for r in d.collect()} for d in (fast, slow))
    assert len(want) > 300 and got == want
    monkeypatch.undo()
    monkeypatch.setattr(swaps, "MOST_NUMBERS", 10)
    assert swaps.SwapTables.of(s.features, meta) is None


def test_tenths_are_rounded_as_spark_does(spark):
    values = [0.25, -0.25, 0.05, 1.45, 2.675, 0.35000000000000003, 0.0, 12.349999999999, 0.15, -7.05]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 1)).collect()]
    assert (swaps._rounded(np.array([values]))[0] / 10.0).tolist() == want
