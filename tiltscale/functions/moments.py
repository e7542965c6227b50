"""Moments of left-truncated count distributions, for many parameters at once.

Up to ``NEAR`` terms are added one by one. The rest of a sum is an integral over log x plus
the first terms of the Euler-Maclaurin series; panels of Gauss-Legendre points cover the
mode and the tail, so that neither a large mean nor a heavy tail takes more terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import special
from .truncated import Likelihood, log_rising, mcnb_steps, numbered

#: Counts that are summed term by term, tails taken together, panels and points of a panel.
NEAR, TOGETHER, PANELS, POINTS = 200, 500, 40, 16


@dataclass
class Moments:
    """Mean and variance of log2 X, and the mean of X, by group."""

    first: np.ndarray
    variance: np.ndarray
    mean: np.ndarray


def _log_pmf(dist: str, x: np.ndarray, r: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of real x, one or more, without truncation."""
    if dist == "nb":
        return log_rising(x + 1, r - 1) - special._np_lgamma(r) + x * np.log(p) + r * np.log1p(-p)
    a, b = p * k, (1 - p) * k
    return log_rising(x + 1, r - 1) - special._np_lgamma(r) - log_rising(x + a, b + r) + log_rising(a, b) + log_rising(b, r)


def _weights(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(x), np.log2(x), np.log2(x) ** 2, x])


def _near(dist: str, r: np.ndarray, k: np.ndarray, p: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over left < x < NEAR of the probability, times log2 x, its square, and x (rows); and
    whether what is above does not matter."""
    lw = _log_pmf(dist, np.full_like(r, left + 1.0), r, k, p)
    w, out = np.exp(lw), np.zeros((4, len(r)))
    a, b = p * k, (1 - p) * k
    for x in range(left + 1, NEAR):
        t = np.log2(x)
        wt = w * t
        out[0] += w
        out[1] += wt
        out[2] += wt * t
        out[3] += w * x
        w = w * ((p * (x + r) / (x + 1)) if dist == "nb" else ((x + r) * (x + a) / ((x + 1) * (x + k + r))))
    if (deep := lw < -600).any():  # powers that would vanish before they grow
        xs = np.arange(left + 1, NEAR, dtype=float)
        out[:, deep] = np.einsum("gx,wx->wg", np.exp(_log_pmf(dist, xs, *(v[deep, None] for v in (r, k, p)))), _weights(xs))
    if dist == "nb":
        rate = np.maximum(p * (NEAR + r) / (NEAR + 1), p)
        small = w * NEAR**2 < 1e-17 * (1 - rate) ** 2 * out[0]
    else:
        rate = (NEAR + r) * (NEAR + a) / ((NEAR + 1) * (NEAR + k + r))
        small = (b > 3) & (rate < 1) & (w * NEAR**3 < 1e-17 * out[0])
    return out, small & ~deep


def _sums(dist: str, r: np.ndarray, k: np.ndarray, p: np.ndarray, left: int) -> np.ndarray:
    """The same sums over all x > left."""
    out, small = _near(dist, r, k, p, left)
    rest = np.flatnonzero(~small)
    for i in range(0, len(rest), TOGETHER):
        part = rest[i : i + TOGETHER]
        out[:, part] += _far(dist, r[part], k[part], p[part])
    return out


def _far(dist: str, r: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same sums over x from NEAR on."""
    r, k, p = (v[:, None] for v in (r, k, p))
    # how far the tail goes: an exponential one to 50 deviations, a power law until nothing is left
    if dist == "nb":
        top = (r * p + 50 * np.sqrt(r * p)) / (1 - p) + 60 / -np.log(p) + NEAR
        low, high = np.full_like(r, np.log(NEAR)), np.log(top)
        mode, width = np.log(np.maximum(r * p / (1 - p), NEAR)), 1 / np.sqrt(np.maximum(r * p, 1.0))
    else:
        b = (1 - p) * k
        low = np.full_like(r, np.log(NEAR))
        middle = np.log(np.maximum(r * p / np.maximum(1 - p, 1e-12), NEAR))
        high = middle + 45 / np.maximum(np.minimum(b, r), 1e-3) + 8 / np.sqrt(np.minimum(np.minimum(b, r), p * k)) + 3
        high = np.minimum(high, 600.0)
        mode, width = middle, 1 / np.sqrt(np.minimum(np.minimum(b, r), np.maximum(p * k, 1e-3)))
    # edges that are dense about the mode and even elsewhere
    even = low + (high - low) * np.linspace(0, 1, PANELS + 1)
    dense = np.clip(mode + width * np.linspace(-10, 10, PANELS + 1), low, high)
    edges = np.sort(np.concatenate([even, dense], axis=1), axis=1)
    at, share = np.polynomial.legendre.leggauss(POINTS)
    half = np.diff(edges, axis=1)[:, :, None] / 2
    u = (edges[:, :-1, None] + half * (1 + at)).reshape(len(r), -1)
    x = np.exp(u)
    dens = np.exp(_log_pmf(dist, x, r, k, p) + u) * (half * share).reshape(len(r), -1)
    log2 = u / np.log(2)
    far = np.stack([dens.sum(1), (dens * log2).sum(1), (dens * log2**2).sum(1), (dens * x).sum(1)])
    # sum from NEAR on: the integral, half of the first term, less a twelfth of its slope
    step = 0.5
    ends = np.array([NEAR - step, float(NEAR), NEAR + step])
    f = np.exp(_log_pmf(dist, ends, r, k, p))[None] * _weights(ends)[:, None, :]
    return far + f[:, :, 1] / 2 - (f[:, :, 2] - f[:, :, 0]) / (2 * step) / 12


def _compound(r: np.ndarray, p: np.ndarray, left: int) -> np.ndarray:
    """The sums over all x > left for the compound negative binomial, whose tail falls as p^x: term by term."""
    out = np.zeros((4, len(r)))
    for x, t in enumerate(mcnb_steps(r, p)):
        if x > left:
            w = np.exp(t.value)
            out += w * np.array([1.0, np.log2(x), np.log2(x) ** 2, x])[:, None]
            # terms fall at least as those of NB(r, p), and below this rate for good
            if x % 16 == 0:
                rate = p * (x + r) / (x + 1)
                if ((rate < 1) & (w * x * x < 1e-17 * (1 - rate) * out[0])).all():
                    return out
    return out


def log2_moments(cells: Likelihood, p: np.ndarray) -> Moments:
    """Given X > left, of each group of ``cells`` at its p."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    k = cells.k if cells.k is not None else np.zeros(len(p))
    with np.errstate(all="ignore"):
        sums = _compound(cells.r, p, cells.left) if cells.dist == "mcnb" else _sums(cells.dist, cells.r, k, p, cells.left)
        first = sums[1] / sums[0]
        mean = sums[3] / sums[0]
    if cells.dist == "betanb":
        mean = np.where((1 - p) * k > 1, mean, np.inf)
    return Moments(first, sums[2] / sums[0] - first**2, mean)


class Panels:
    """``log2_moments`` of many p at few (r, k), as Chebyshev series in the logit of p.

    A panel is ``WIDTH`` of the logit at one (r, k); once as many moments as it has nodes
    were asked of it, its series takes over. Panels whose upper end has (1 - p) k at
    most 3 have none, as the mean of a beta negative binomial has a pole at one.
    """

    #: Width of a panel, its nodes, and the most panels that are kept.
    WIDTH, NODES, MOST = 0.5, 16, 50_000

    def __init__(self, dist: str = "nb", left: int = 4) -> None:
        self.dist, self.left = dist, left
        self.nodes = np.cos(np.pi * (np.arange(self.NODES) + 0.5) / self.NODES)
        self.fit = np.linalg.inv(np.polynomial.chebyshev.chebvander(self.nodes, self.NODES - 1))
        self.asked, self.rows, self.series = {}, {}, np.empty((0, self.NODES, 3))

    def _direct(self, r: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
        m = log2_moments(Likelihood(self.dist, np.empty(0), np.empty(0, np.int64), r, k, self.left), p)
        return np.stack([m.first, m.variance, m.mean], axis=1)

    def at(self, cells: Likelihood, p: np.ndarray) -> Moments:
        """Given X > left, of each group of ``cells`` at its p."""
        r, k = cells.r, cells.k if cells.k is not None else np.zeros(len(p))
        u = np.log(np.clip(p, 1e-9, 1 - 1e-9))
        u = u - np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))
        panel = np.floor(u / self.WIDTH)
        first, of = numbered(r, k, panel)
        count = np.bincount(of, minlength=len(first))
        keys = list(zip(r[first].tolist(), k[first].tolist(), panel[first].tolist(), strict=True))
        if len(self.asked) + len(keys) > self.MOST:
            self.asked, self.rows, self.series = {}, {}, np.empty((0, self.NODES, 3))
        new = []
        for key, n in zip(keys, count.tolist(), strict=True):
            self.asked[key] = self.asked.get(key, 0) + n
            pole = self.dist == "betanb" and key[1] / (1 + np.exp((key[2] + 1) * self.WIDTH)) <= 3
            if key not in self.rows and self.asked[key] >= self.NODES and not pole:
                new.append(key)
        if new:
            rs, ks, low = (np.repeat(np.array(c), self.NODES) for c in zip(*new, strict=True))
            at = (low + (np.tile(self.nodes, len(new)) + 1) / 2) * self.WIDTH
            values = self._direct(rs, ks, 1 / (1 + np.exp(-at))).reshape(len(new), self.NODES, 3)
            self.rows |= {key: len(self.rows) + i for i, key in enumerate(new)}
            self.series = np.concatenate([self.series, np.einsum("ij,gjm->gim", self.fit, values)])
        row = np.array([self.rows.get(key, -1) for key in keys], np.int64)[of]
        out, known = np.empty((len(p), 3)), row >= 0
        t, c = 2 * (u[known] / self.WIDTH - panel[known]) - 1, row[known]
        out[known] = np.einsum("gi,gim->gm", np.polynomial.chebyshev.chebvander(t, self.NODES - 1), self.series[c])
        out[~known] = self._direct(r[~known], k[~known], p[~known])
        return Moments(*out.T)
