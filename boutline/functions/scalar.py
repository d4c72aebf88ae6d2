"""Column expressions shared by several operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of meta strength and the cap on popularity.
META_WIN_WEIGHT = 0.7
META_POP_WEIGHT = 0.3
META_POP_CAP = 0.5


def meta_strength(win_rate: Column, popularity: Column) -> Column:
    return win_rate * META_WIN_WEIGHT + F.least(popularity, F.lit(META_POP_CAP)) * META_POP_WEIGHT


def ratio(num: Column, den: Column, default: float) -> Column:
    """num / den as double, ``default`` where den is 0 or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def patch_part(patch: Column | str, i: int) -> Column:
    return F.coalesce(F.get(F.split(patch, r"\."), F.lit(i)).try_cast("int"), F.lit(0))


def patch_number(patch: Column | str) -> Column:
    """'major.minor' as major*100+minor; 0 if the text is not a patch."""
    major = F.get(F.split(patch, r"\."), F.lit(0)).try_cast("int")
    minor_text = F.get(F.split(patch, r"\."), F.lit(1))
    minor = F.when(minor_text.isNull(), 0).otherwise(minor_text.try_cast("int"))
    return F.coalesce(major * 100 + minor, F.lit(0))


def row_mean(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols)))


def row_std(cols: list[Column]) -> Column:
    """Sample standard deviation over the columns of one row."""
    m = row_mean(cols)
    return F.sqrt(reduce(lambda a, b: a + b, [(c - m) * (c - m) for c in cols]) / F.lit(float(len(cols) - 1)))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a: Column) -> Column:
    """Sample standard deviation of a double array; 0 below two items."""
    m = array_mean(a)
    ss = F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 1, F.sqrt(ss / (F.size(a) - 1))).otherwise(F.lit(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def interval_bin(p: Column, bins: int = 10) -> Column:
    """1-based bin of (lo, hi] with edges i*(1/bins); 0 for p <= 0."""
    return reduce(lambda a, b: a + b, [(p > F.lit(i * (1 / bins))).cast("int") for i in range(bins)])


# p-values are needed on single result rows only; these are closed forms or
# short series, no external library.


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_1_sf(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def ks_sf(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 0.2:
        return 1.0
    s = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, s))


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_cf(a, b, x) / a
    return 1 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))
