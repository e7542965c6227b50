"""Special functions as Column expressions; none of these is built into Spark."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanczos coefficients for g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Most steps of a continued fraction or series; it ends when no value moves.
STEPS = 20_000


def lgamma(x: Column) -> Column:
    """log Gamma for positive ``x``."""
    z = x - 1
    total = reduce(lambda a, b: a + b, [F.lit(c) / (z + i) for i, c in enumerate(LANCZOS) if i], F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def lbeta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def _np_lgamma(x: np.ndarray) -> np.ndarray:
    z = x - 1
    total = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS) if i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def _np_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta function's continued fraction, by modified Lentz steps.

    Values that no longer move are set aside, so a batch does not wait for its slowest one.
    """
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    out, live = np.empty_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, STEPS + 1):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + term * d)
            c = safe(1 + term / c)
            h = h * c * d
        moves = np.abs(c * d - 1) >= 1e-15
        if not moves.all() and (m % 8 == 0 or not moves.any()):
            out[live[~moves]] = h[~moves]
            live, a, b, x, c, d, h = (v[moves] for v in (live, a, b, x, c, d, h))
            if not len(live):
                return out
    out[live] = h
    return out


def np_betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - (_np_lgamma(a) + _np_lgamma(b) - _np_lgamma(a + b)))
        low = x < (a + 1) / (a + b + 2)
        aa, bb, xx = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
        part = front * _np_fraction(aa, bb, xx) / aa
        out = np.where(low, part, 1 - part)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)))


def np_gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - _np_lgamma(a))
        term = total = 1 / a
        first = d = h = 1 / (x + 1 - a)
        c = np.full_like(x, 1e300)
        below = x < a + 1
        for n in range(1, STEPS + 1):
            term = np.where(below, term * x / (a + n), 0.0)
            total = total + term
            an, b = -n * (n - a), x + 2 * n + 1 - a
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * c * d
            moved = np.where(below, term / total, c * d - 1)
            if not (np.abs(moved) > 1e-15).any():
                break
        out = np.where(below, 1 - front * total, front * h)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 1.0, out))


# many rounds of a continued fraction are many times faster on Arrow batches than as nested lambdas
@F.pandas_udf(T.DoubleType())
def betainc(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """Regularised incomplete beta function."""
    return pd.Series(np_betainc(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _gamma_upper(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(np_gammaincc(a.to_numpy(float), x.to_numpy(float)))


def t_sf(t: Column, df: Column) -> Column:
    """Upper tail of Student's t."""
    tail = 0.5 * betainc(df / 2, F.lit(0.5), df / (df + t * t))
    return F.when(t >= 0, tail).otherwise(1 - tail)


def chi2_sf(x: Column, df: Column | int) -> Column:
    df = df if isinstance(df, Column) else F.lit(float(df))
    return _gamma_upper(df / 2, x / 2)


def chi2_sf_even(x: Column, half: Column) -> Column:
    """Upper tail for ``2 * half`` degrees of freedom: exp(-x/2) sum of (x/2)^i / i! for i < half."""
    y = x / 2
    start = F.struct(F.lit(0.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log(y) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (s["total"] + F.exp(term)).alias("total"))

    more = F.when(half >= 2, F.sequence(F.lit(1), (half - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(y <= 0, 1.0).otherwise(F.exp(-y + F.log(F.aggregate(more, start, step, lambda s: s["total"]))))


def norm_sf(z: Column) -> Column:
    tail = 0.5 * _gamma_upper(F.lit(0.5), z * z / 2)
    return F.when(z >= 0, tail).otherwise(1 - tail)
