"""Estimating parameters of the count models.

Fits run on count tables, which hold one row per distinct pair. A group of a fit is one
(BAD, allele) and window, so its size is bounded by the counts, not by the observations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import _np_lgamma
from . import qc

ALLELE = ["bad", "allele"]


def strategy(counts: DataFrame, small: int = 10_000) -> DataFrame:
    """Per BAD: its observations, and whether it is too small to fit."""
    total = counts.groupBy("bad").agg(F.sum("n").alias("n"))
    return total.withColumn("strategy", F.when(F.col("n") < small, "conservative").otherwise("fit"))


def meta(counts: DataFrame, dist: str = "NB", alpha: float | None = None) -> DataFrame:
    """One row per (BAD, allele): the distribution and the prior's weight."""
    return counts.select("bad").distinct().select("bad", F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("allele"), F.lit(dist).alias("dist"), F.lit(alpha).cast("double").alias("alpha"))


def with_fixed(params: DataFrame, fixed: DataFrame) -> DataFrame:
    """Estimates replaced by fixed values (name, value, priority); the highest priority wins."""
    last = fixed.groupBy("name").agg(F.max_by("value", "priority").alias("value"))
    return params.join(F.broadcast(last), "name", "left").withColumn("est", F.coalesce("value", "est")).drop("value")


def parse_fixed(text: str) -> list[tuple[str, float, int]]:
    """``"b=1;mu=0"`` as rows of (name, value, priority): later entries win."""
    return [(k.strip(), float(v), i) for i, (k, v) in enumerate(x.split("=") for x in text.split(";") if x.strip())]


def _lbeta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _np_lgamma(a) + _np_lgamma(b) - _np_lgamma(a + b)


def binomial_nll(x: np.ndarray, total: np.ndarray, n: np.ndarray, p: float, k: float | None, left: int) -> float:
    """Negative log likelihood of (beta-)binomial cells truncated to left < x < total - left."""
    out = 0.0
    for t in np.unique(total):
        y = np.arange(left + 1, t - left, dtype=float)
        lp = _np_lgamma(np.array([t + 1.0])) - _np_lgamma(y + 1) - _np_lgamma(t - y + 1)
        lp = lp + (y * math.log(p) + (t - y) * math.log1p(-p) if k is None else _lbeta(y + p * k, t - y + (1 - p) * k))
        lp -= lp.max() + math.log(np.exp(lp - lp.max()).sum())
        at = total == t
        out -= float((n[at] * lp[(x[at] - left - 1).astype(int)]).sum())
    return out


def inverse_kl(x: np.ndarray, total: np.ndarray, n: np.ndarray, p: float, k: float | None, left: int) -> float:
    """Sum over totals of their share times KL(model || counts), the counts smoothed by a half."""
    out = 0.0
    for t in np.unique(total):
        y = np.arange(left + 1, t - left, dtype=float)
        lp = _np_lgamma(np.array([t + 1.0])) - _np_lgamma(y + 1) - _np_lgamma(t - y + 1)
        lp = lp + (y * math.log(p) + (t - y) * math.log1p(-p) if k is None else _lbeta(y + p * k, t - y + (1 - p) * k))
        lp -= lp.max() + math.log(np.exp(lp - lp.max()).sum())
        seen = np.full(len(y), 0.5)
        at = total == t
        np.add.at(seen, (x[at] - left - 1).astype(int), n[at])
        out += float(n[at].sum() * (np.exp(lp) * (lp - np.log(seen / seen.sum()))).sum())
    return out / n.sum()


def _refined(f, grid: np.ndarray, rounds: int = 8) -> float:
    """Least point of ``f``: the grid's best cell, then ever finer grids in it."""
    lo_all, hi_all = grid[0], grid[-1]
    best = float(grid[int(np.argmin([f(g) for g in grid]))])
    width = grid[1] - grid[0]
    for _ in range(rounds):
        grid = np.clip(np.linspace(best - width, best + width, 9), lo_all, hi_all)
        best, width = float(grid[int(np.argmin([f(g) for g in grid]))]), width / 4
    return best


def estimate_binomial(oriented: DataFrame, name: str, left: int = 4, k: float | None = None, objective: str = "likelihood") -> DataFrame:
    """Per (BAD, allele) p of the binomial, or k of the beta-binomial with p = bad / (bad + 1).

    Cells are weighted by how often they occur.
    """
    loss = binomial_nll if objective == "likelihood" else inverse_kl

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, total, n = (pdf[c].to_numpy(float) for c in ("x", "total", "n"))
        bad = float(pdf["bad"].iloc[0])
        if name == "p":
            best = _refined(lambda p: loss(x, total, n, p, k, left), np.linspace(0.01, 0.99, 10)[1:-1])
        else:
            best = _refined(lambda c: loss(x, total, n, bad / (bad + 1), c, left), np.linspace(0, 1000, 50)[1:-1], 6)
        return pd.DataFrame({"bad": [bad], "allele": [pdf["allele"].iloc[0]], "name": [name], "est": [best], "n": [int(n.sum())]})

    cells = oriented.withColumn("total", F.col("x") + F.col("slice")).groupBy(*ALLELE, "x", "total").agg(F.sum("n").alias("n"))
    return cells.groupBy(*ALLELE).applyInPandas(solve, "bad double, allele string, name string, est double, n long")


#: Parameters of a window: r = mu + b * slice, weight of the first mode, k = mu_k + b_k * slice, both modes' p.
NAMES = ("b", "mu", "w", "mu_k", "b_k", "p1", "p2")
#: Least r and k of a cell.
LEAST = 0.1
_LOGIT, _LOG = ("w", "p1", "p2"), ("mu_k",)


def transformed_r(r: np.ndarray, p: float, k: np.ndarray | None, transform: str) -> np.ndarray:
    """r so that the distribution's mean is that of NB(r, p) (``NB``), or r itself (``mean``)."""
    if transform == "none":
        return r
    per_r = p / (1 - p) if k is None else p * k / np.maximum((1 - p) * k - 1, 1e-3)
    return r * (p / (1 - p) if transform == "NB" else 1.0) / per_r


@dataclass
class WindowCells:
    """Distinct cells (x, slice) of a window and how often they occur."""

    x: np.ndarray
    s: np.ndarray
    n: np.ndarray
    left: int

    def __post_init__(self) -> None:
        self.log_x = _np_lgamma(self.x + 1)

    def nll(self, t: dict[str, float], beta: bool = False, transform: str = "none", k_max: float = 10_000.0) -> float:
        """Negative log likelihood of w * D(p1) + (1 - w) * D(p2), D left-truncated (beta-)NB."""
        x, s = self.x, self.s
        plain = np.maximum(t["mu"] + t["b"] * s, LEAST)
        k = np.clip(t["mu_k"] + t["b_k"] * s, LEAST, k_max) if beta else None
        total = 0.0
        for share, p in ((t["w"], t["p1"]), (1 - t["w"], t["p2"])):
            if share <= 0:
                continue
            r = transformed_r(plain, p, k, transform)
            lp = _np_lgamma(x + r) - _np_lgamma(r) - self.log_x
            if k is None:
                lp = lp + x * math.log(p) + r * math.log1p(-p)
                term = head = np.exp(r * math.log1p(-p))
                for i in range(self.left):
                    term = term * p * (r + i) / (i + 1)
                    head = head + term
            else:
                a, c = p * k, (1 - p) * k
                lp = lp + _lbeta(a + x, c + r) - _lbeta(a, c)
                term = head = np.exp(_lbeta(a, c + r) - _lbeta(a, c))
                for i in range(self.left):
                    term = term * (i + r) * (i + a) / ((i + 1) * (i + a + c + r))
                    head = head + term
            total = total + share * np.exp(lp) / np.maximum(1 - head, 1e-12)
        return -float((self.n * np.log(np.maximum(total, 1e-300))).sum())


def _derivatives(f: Callable[[np.ndarray], float], at: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian by central differences."""
    d, mid = len(at), f(at)
    step = np.diag(h)
    up, down = np.array([f(at + step[i]) for i in range(d)]), np.array([f(at - step[i]) for i in range(d)])
    hess = np.diag((up - 2 * mid + down) / h**2)
    for i in range(d):
        for j in range(i):
            cross = f(at + step[i] + step[j]) - f(at + step[i] - step[j]) - f(at - step[i] + step[j]) + f(at - step[i] - step[j])
            hess[i, j] = hess[j, i] = cross / (4 * h[i] * h[j])
    return mid, (up - down) / (2 * h), hess


def minimise(f: Callable[[np.ndarray], float], at: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton's method with the Hessian's eigenvalues made positive and steps halved until they help."""
    h = np.full(len(at), 1e-3)
    for _ in range(rounds):
        value, grad, hess = _derivatives(f, at, h)
        if not np.isfinite(hess).all():
            return at
        size, axes = np.linalg.eigh(hess)
        size = np.maximum(np.abs(size), 1e-6 * max(1.0, float(np.abs(size).max())))
        move = -axes @ ((axes.T @ grad) / size)
        move *= min(1.0, 4.0 / float(np.abs(move).max() or 1.0))
        for _ in range(30):
            if (now := f(at + move)) < value:
                break
            move = move / 2
        else:
            return at
        at = at + move
        if value - now < 1e-10 * max(1.0, abs(value)):
            return at
    return at


def _to_free(name: str, v: float) -> float:
    v = min(max(v, 1e-6), 1 - 1e-6) if name in _LOGIT else v
    return math.log(v / (1 - v)) if name in _LOGIT else math.log(max(v, 1e-6)) if name in _LOG else v


def _from_free(name: str, v: float) -> float:
    v = float(np.clip(v, -30, 30)) if name in (*_LOGIT, *_LOG) else float(v)
    return 1 / (1 + math.exp(-v)) if name in _LOGIT else math.exp(v) if name in _LOG else v


def penalty(k: np.ndarray, prior: str, weight: float) -> float:
    """Minus log prior of the mean dispersion 1 / k: Laplace or normal about zero, so that it asks for a large k."""
    u = float(np.mean(1 / k))
    return weight * (u if prior == "laplace" else u * u / 2)


def fit_cells(
    cells: WindowCells, bad: float, fixed: dict[str, float] | None = None, estimate_w: bool = True, estimate_p: bool = False, beta: bool = False,
    alpha: float = 0.0, prior: str = "laplace", k_min: float = 0.0, k_max: float = 10_000.0, transform: str = "none", regul_n: bool = True, regul_slice: bool = True,
) -> tuple[dict[str, float], dict[str, float], float]:
    """Estimates, standard errors (zero of what is fixed) and the negative log likelihood.

    At BAD 1 both modes coincide and w is one. ``alpha``, times observations and mean
    slice, weighs the prior on the dispersion. Errors come from the whole information
    matrix; where it is not positive they are undefined (nan).
    """
    held = {"w": 1.0} if bad == 1 or not estimate_w else {}
    held |= {} if beta else {"mu_k": 0.0, "b_k": 0.0}
    held |= {} if estimate_p else {"p1": bad / (bad + 1), "p2": 1 / (bad + 1)}
    held |= fixed or {}
    start = {"b": 1.0, "mu": 0.0, "w": 0.5, "mu_k": 50.0, "b_k": 0.0, "p1": bad / (bad + 1), "p2": 1 / (bad + 1)} | held
    free = [c for c in NAMES if c not in held]
    scale = alpha * (cells.n.sum() if regul_n else 1.0) * (float(np.average(cells.s, weights=cells.n)) if regul_slice else 1.0)

    def loss(t: dict[str, float]) -> float:
        extra = 0.0
        if beta:
            k = t["mu_k"] + t["b_k"] * cells.s
            extra = 1e3 * float(np.maximum(k_min - k, 0).sum())
            if alpha:
                extra += penalty(np.clip(k, LEAST, k_max), prior, scale)
        return cells.nll(t, beta, transform, k_max) + extra

    def at(v: np.ndarray) -> dict[str, float]:
        return start | {c: _from_free(c, x) for c, x in zip(free, v, strict=True)}

    tries = [start | {"b": b, "w": w} | held for b in (0.5, 1.0, 1.5) for w in (0.2, 0.5, 0.8)]
    first = min(tries, key=loss)
    best = at(minimise(lambda v: loss(at(v)), np.array([_to_free(c, first[c]) for c in free]))) if free else start
    errors = dict.fromkeys(NAMES, 0.0)
    if free:
        point = np.array([best[c] for c in free])
        steps = np.array([min(1e-3, best[c] / 4, (1 - best[c]) / 4) if c in _LOGIT else 1e-3 * max(1.0, abs(best[c])) for c in free])
        _, _, info = _derivatives(lambda v: loss(start | dict(zip(free, map(float, v), strict=True))), point, steps)
        sound = np.isfinite(info).all() and np.linalg.eigvalsh(info).min() > 0
        spread = np.sqrt(np.diag(np.linalg.inv(info))) if sound else np.full(len(free), np.nan)
        errors |= dict(zip(free, map(float, spread), strict=True))
    return best, errors, cells.nll(best, beta, transform, k_max)


def fit_windows(oriented: DataFrame, windows: DataFrame, left: int = 4, beta: bool = False, **options) -> DataFrame:
    """Parameters of every window with standard errors: bad, allele, slice (the centre), name, est, std, nll.

    ``windows``: bad, allele, centre, lo, hi. One window over all slices is the line
    layout, one per slice the slices layout. ``options`` are those of ``fit_cells``.
    """
    names = [c for c in NAMES if beta or c not in ("mu_k", "b_k")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bad, centre = float(pdf["bad"].iloc[0]), int(pdf["centre"].iloc[0])
        cells = WindowCells(*(pdf[c].to_numpy(float) for c in ("x", "slice", "n")), left)
        est, std, nll = fit_cells(cells, bad, beta=beta, **options)
        return pd.DataFrame([(bad, pdf["allele"].iloc[0], centre, c, est[c], std[c], nll) for c in names], columns=["bad", "allele", "slice", "name", "est", "std", "nll"])

    met = oriented.join(windows.select(*ALLELE, "centre", "lo", "hi"), ALLELE).where("slice BETWEEN lo AND hi")
    return met.groupBy(*ALLELE, "centre").applyInPandas(solve, "bad double, allele string, slice int, name string, est double, std double, nll double")


def line_window(oriented: DataFrame) -> DataFrame:
    """The one window over all slices of each (BAD, allele)."""
    return oriented.groupBy(*ALLELE).agg(F.lit(0).alias("centre"), F.min("slice").alias("lo"), F.max("slice").alias("hi"))


def slice_window(oriented: DataFrame) -> DataFrame:
    """One window for each slice."""
    return oriented.select(*ALLELE, F.col("slice").alias("centre"), F.col("slice").alias("lo"), F.col("slice").alias("hi")).distinct()


def small_bads(oriented: DataFrame, small: int) -> DataFrame:
    """BADs with fewer observations than ``small``: each is counted once, by its ref slices."""
    return oriented.where("allele = 'ref'").groupBy("bad").agg(F.sum("n").alias("n")).where(F.col("n") < small).select("bad")


def fit_project(oriented: DataFrame, windows: DataFrame, left: int = 4, small: int = 10_000, small_strategy: str = "conservative", beta: bool = False, **options) -> DataFrame:
    """``fit_windows`` where small BADs take their strategy instead.

    ``conservative``: b = 1, mu = 0, w = 1 without a concentration; ``fixed_r``: b = 1,
    mu = 0 and the rest estimated.
    """
    few = F.broadcast(small_bads(oriented, small))
    large, rest = oriented.join(few, "bad", "left_anti"), oriented.join(few, "bad", "left_semi")
    fits = fit_windows(large, windows, left, beta, **options)
    fixed = {"b": 1.0, "mu": 0.0} | ({"w": 1.0} if small_strategy == "conservative" else {}) | (options.pop("fixed", None) or {})
    keep = beta and small_strategy != "conservative"
    return fits.unionByName(fit_windows(rest, windows, left, keep, fixed=fixed, **options))


def wide_params(fits: DataFrame) -> DataFrame:
    """One row per window: bad, allele, slice and the parameters, null where not estimated."""
    return fits.groupBy(*ALLELE, "slice").agg(*[F.max(F.when(F.col("name") == c, F.col("est"))).alias(c) for c in NAMES])


def scoring_params(fits: DataFrame, wanted: DataFrame) -> DataFrame:
    """bad, allele, slice, r, k, w, p1, p2 of every wanted slice: the nearest window's, evaluated at the slice.

    A (BAD, allele) without any window, as when its lowest slice is too thin to fit, takes
    the conservative parameters: r is the slice, w is one.
    """
    slices = wanted.select(*ALLELE, "slice").distinct()
    near = slices.join(qc.nearest_params(wanted, wide_params(fits).withColumn("fit_order", F.col("slice"))), [*ALLELE, "slice"], "left")
    none, bad = F.col("b").isNull(), F.col("bad")
    r = F.when(none, F.col("slice").cast("double")).otherwise(F.greatest(F.col("mu") + F.col("b") * F.col("slice"), F.lit(LEAST)))
    k = F.when(F.col("mu_k").isNotNull(), F.greatest(F.col("mu_k") + F.col("b_k") * F.col("slice"), F.lit(LEAST)))
    either = lambda c, other: F.when(none, other).otherwise(F.col(c))
    return near.select(*ALLELE, "slice", r.alias("r"), k.alias("k"), either("w", F.lit(1.0)).alias("w"), either("p1", bad / (bad + 1)).alias("p1"), either("p2", 1 / (bad + 1)).alias("p2"))
