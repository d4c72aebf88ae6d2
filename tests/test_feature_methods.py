"""Generated Java methods of the feature vector are small enough to be compiled."""

import contextlib
import io
import re

import pytest

from boutline import fixtures as fx
from boutline.operators.features import FeatureModel
from boutline.session import cut_lineage

# Fixed value: HotSpot interprets methods of more bytes than this.
HUGE = 8000


@pytest.mark.parametrize("past", ["rows", "snapshot"])
def test_methods_of_the_vector_are_compiled(spark, sf, past):
    w = cut_lineage(fx.wide(spark, sf))
    out = FeatureModel.fit(w).vector(w, past)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            out.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < HUGE
