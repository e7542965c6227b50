"""Left-truncated count distributions in flat numpy arrays: log probabilities, and their
first and second derivatives in p.

``nb`` is the negative binomial, ``betanb`` the beta negative binomial (p the mean, k the
concentration), ``mcnb`` the marginalised compound negative binomial. Terms free of p are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import special

DISTS = ("nb", "betanb", "mcnb")
_SHIFT = 12


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of each distinct row of ``columns``, and each row's number among these."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, at = np.unique(c, return_inverse=True)
        code = code * max(len(values), 1) + at
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code


def digamma(x: np.ndarray) -> np.ndarray:
    near = x < _SHIFT  # Stirling's series holds from there on
    z = np.where(near, x + _SHIFT, x)
    u = 1 / (z * z)
    out = np.log(z) - 0.5 / z - u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u / 132))))
    if near.any():
        out[near] -= sum(1 / (x[near] + i) for i in range(_SHIFT))
    return out


def trigamma(x: np.ndarray) -> np.ndarray:
    near = x < _SHIFT
    z = np.where(near, x + _SHIFT, x)
    u = 1 / (z * z)
    out = 1 / z + u / 2 + u / z * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * 5 / 66))))
    if near.any():
        out[near] += sum(1 / (x[near] + i) ** 2 for i in range(_SHIFT))
    return out


def log_rising(z: np.ndarray, r: np.ndarray) -> np.ndarray:
    """log Gamma(z + r) - log Gamma(z), without the digits that a difference of large logarithms loses."""
    z, r = np.broadcast_arrays(np.asarray(z, float), np.asarray(r, float))
    up = np.maximum(z, _SHIFT)  # Stirling's series, where it holds

    def tail(v: np.ndarray) -> np.ndarray:
        w = 1 / v
        u = w * w
        return w * (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u / 1680)))

    far = (up - 0.5) * np.log1p(r / up) + r * np.log(up + r) - r + tail(up + r) - tail(up)
    near = z < _SHIFT
    if near.any():
        far = far.copy()
        far[near] = special._np_lgamma(z[near] + r[near] + 1) - np.log(z[near] + r[near]) - special._np_lgamma(z[near] + 1) + np.log(z[near])
    return far


@dataclass
class Terms:
    """Log probability and its first and second derivative in p."""

    value: np.ndarray
    slope: np.ndarray
    bend: np.ndarray

    def __sub__(self, other: Terms) -> Terms:
        return Terms(self.value - other.value, self.slope - other.slope, self.bend - other.bend)

    def at(self, index: np.ndarray) -> Terms:
        return Terms(self.value[index], self.slope[index], self.bend[index])


def _nb_mass(r: np.ndarray, p: np.ndarray, left: int) -> Terms:
    """Of P(X > left)."""
    head = term = (1 - p) ** r
    for i in range(left):
        term = term * p * (r + i) / (i + 1)
        head = head + term
    mass = 1 - head
    small = mass < 0.05
    if small.any():
        mass = mass.copy()
        mass[small] = special.np_betainc(np.full(int(small.sum()), left + 1.0), r[small], p[small])
    mass = np.maximum(mass, 1e-300)
    log_beta = special._np_lgamma(np.array(left + 1.0)) - log_rising(r, left + 1.0)
    first = np.exp(left * np.log(p) + (r - 1) * np.log1p(-p) - log_beta - np.log(mass))
    return Terms(np.log(mass), first, first * (left / p - (r - 1) / (1 - p) - first))


def _truncation(value: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> Terms:
    """Of P(X > left), from the terms (rows) of x = 0 to left."""
    t = np.exp(value)
    mass = np.maximum(-np.expm1(value[0]) - t[1:].sum(axis=0), 1e-300)
    first, second = -(t * slope).sum(axis=0) / mass, -(t * (slope**2 + bend)).sum(axis=0) / mass
    return Terms(np.log(mass), first, second - first**2)


def _betanb_mass(r: np.ndarray, k: np.ndarray, p: np.ndarray, left: int) -> Terms:
    a, b = p * k, (1 - p) * k
    value = [log_rising(b, r) - log_rising(k, r)]
    slope, bend = [-k * (digamma(b + r) - digamma(b))], [k**2 * (trigamma(b + r) - trigamma(b))]
    for x in range(left):
        value.append(value[-1] + np.log((x + r) * (x + a) / ((x + 1) * (x + k + r))))
        slope.append(slope[-1] + k / (x + a))
        bend.append(bend[-1] - (k / (x + a)) ** 2)
    mass = _truncation(np.array(value), np.array(slope), np.array(bend))
    small = mass.value < np.log(1e-3)
    if small.any():  # one less the head has few digits there, and the terms above fall fast
        far, sound = _betanb_above(r[small], k[small], p[small], left, value[-1][small], slope[-1][small], bend[-1][small])
        at = np.flatnonzero(small)[sound]
        mass.value[at], mass.slope[at], mass.bend[at] = far.value[sound], far.slope[sound], far.bend[sound]
    return mass


def _betanb_above(r: np.ndarray, k: np.ndarray, p: np.ndarray, left: int, value: np.ndarray, slope: np.ndarray, bend: np.ndarray, most: int = 2000) -> tuple[Terms, np.ndarray]:
    """Of P(X > left) by its terms, given that of x = left; and where these have died away."""
    a = p * k
    scale = value  # terms are taken relative to that of x = left
    t, total, first, second = np.ones_like(r), 0.0, 0.0, 0.0
    for x in range(left, left + most):
        t = t * (x + r) * (x + a) / ((x + 1) * (x + k + r))
        slope, bend = slope + k / (x + a), bend - (k / (x + a)) ** 2
        total, first, second = total + t, first + t * slope, second + t * (slope**2 + bend)
        if x % 16 == 0 and (t * (x + 1) < 1e-17 * total).all():
            break
    mean = first / total
    return Terms(scale + np.log(total), mean, second / total - mean**2), t * (x + 1) < 1e-13 * total


def mcnb_steps(r: np.ndarray, p: np.ndarray, last: np.ndarray | None = None) -> Iterator[Terms]:
    """Of P(X = 0), P(X = 1), ...: x given m is NB(m, p) and m is binomial (r, 1 - p) without zero.

    The sum over m is r q F(1 - r, x + 1; 2; -q) with q = (1 - p)^2 / p, and Gauss's relation
    between neighbours gives the ratio of F at x + 1 and x from that at x and x - 1. Ratios and their
    derivatives in q are all that is kept, so no power overflows. Real r are allowed.
    ``last``, in falling order, is the largest x wanted of each; those beyond theirs are left out.
    """
    q, q1, q2 = (1 - p) ** 2 / p, 1 - 1 / p**2, 2 / p**3
    u, grow = 1 + q, np.log1p(q)
    e = np.exp(-r * grow)
    rest = np.maximum(-np.expm1(-r * grow), 1e-300)
    # log F, and its derivatives in q
    f, f1 = r * grow + np.log(rest) - np.log(r * q), r / (u * rest) - 1 / q
    f2 = -(r / (u**2 * rest)) * (1 + r * e / rest) + 1 / q**2
    none = np.maximum(-np.expm1(r * np.log(p)), 1e-300)
    pr = np.exp((r - 1) * np.log(p))
    base, base1 = np.log(r) + np.log(q) - np.log(none), r * pr / none
    base2 = r * ((r - 1) * np.exp((r - 2) * np.log(p)) * none + r * pr**2) / none**2
    log_p, per_p, per_p2, x, n = np.log(p), 1 / p, 1 / p**2, 0, len(r)
    while True:
        if last is not None and (kept := int(np.searchsorted(-last, -x, "right"))) < n:
            n = kept
            r, q, q1, q2, u, grow, f, f1, f2, base, base1, base2, log_p, per_p, per_p2 = (v[:n] for v in (r, q, q1, q2, u, grow, f, f1, f2, base, base1, base2, log_p, per_p, per_p2))
            if x > 1:
                s, s1, s2 = s[:n], s1[:n], s2[:n]
        value = (r + x) * log_p + base + f
        per_q = 1 / q
        slope = (r + x) * per_p + base1 + q1 * (per_q + f1)
        bend = -(r + x) * per_p2 + base2 + q2 * (per_q + f1) + q1 * q1 * (f2 - per_q * per_q)
        yield Terms(value, slope, bend)
        if x == 0:
            f, f1, f2 = (r - 1) * grow, (r - 1) / u, -(r - 1) / u**2
        else:
            back = (x - 1) / s if x > 1 else 0.0
            back1 = (x - 1) * s1 / s**2 if x > 1 else 0.0
            back2 = (x - 1) * (s2 / s**2 - 2 * s1**2 / s**3) if x > 1 else 0.0
            deep = (x + 1) * u
            t = (2 * x + q * (x + r) - back) / deep
            t1 = (x + r + back1 - t * (x + 1)) / deep
            t2 = (back2 - 2 * (x + 1) * t1) / deep
            s, s1, s2 = t, t1, t2
            ratio = s1 / s
            f, f1, f2 = f + np.log(s), f1 + ratio, f2 + s2 / s - ratio * ratio
        x += 1


def _mcnb_above(r: np.ndarray, p: np.ndarray, left: int, most: int = 2000) -> tuple[Terms, np.ndarray]:
    """Of P(X > left) by its terms; and where these have died away."""
    total, first, second, scale = 0.0, 0.0, 0.0, None
    for x, now in zip(range(left + most), mcnb_steps(r, p), strict=False):
        if x <= left:
            continue
        scale = now.value if scale is None else scale  # terms are taken relative to the first
        t = np.exp(now.value - scale)
        total, first, second = total + t, first + t * now.slope, second + t * (now.slope**2 + now.bend)
        if x % 4 == 0 and (t * (x + 1) < 1e-17 * total).all():
            break
    mean = first / total
    return Terms(scale + np.log(total), mean, second / total - mean**2), t * (x + 1) < 1e-13 * total


class Likelihood:
    """Cells x of groups with one r, k and p each; ``of`` gives each cell's group."""

    def __init__(self, dist: str, x: np.ndarray, of: np.ndarray, r: np.ndarray, k: np.ndarray | None, left: int) -> None:
        if dist not in DISTS:
            raise ValueError(f"no distribution {dist}")
        self.dist, self.x, self.of, self.r, self.k, self.left = dist, x, of, r, k, left
        if dist == "mcnb":  # groups by their largest x, so that those that go on come first
            top = np.full(len(r), left, np.int64)
            np.maximum.at(top, of, x.astype(np.int64))
            self.rank = np.argsort(-top, kind="stable")
            self.top = top[self.rank]
            place = np.empty(len(r), np.int64)
            place[self.rank] = np.arange(len(r))
            self.place = place[of]
            self.by_x = np.argsort(x, kind="stable")
            self.x_ends = np.searchsorted(x[self.by_x], np.arange(int(top.max(initial=left)) + 2))

    def terms(self, p: np.ndarray) -> Terms:
        """Each cell's terms given x > left, at its group's p."""
        p = np.clip(p, 1e-12, 1 - 1e-12)
        with np.errstate(all="ignore"):
            return self._mcnb(p) if self.dist == "mcnb" else self._plain(p)

    def _plain(self, p: np.ndarray) -> Terms:
        x, r, q = self.x, self.r[self.of], p[self.of]
        if self.dist == "nb":
            own = Terms(x * np.log(q) + r * np.log1p(-q), x / q - r / (1 - q), -x / q**2 - r / (1 - q) ** 2)
            return own - _nb_mass(self.r, p, self.left).at(self.of)
        k = self.k[self.of]
        a, b = q * k, (1 - q) * k
        value = log_rising(a, x) + log_rising(b, r)
        slope = k * (digamma(a + x) - digamma(a) - digamma(b + r) + digamma(b))
        bend = k**2 * (trigamma(a + x) - trigamma(a) + trigamma(b + r) - trigamma(b))
        return Terms(value, slope, bend) - _betanb_mass(self.r, self.k, p, self.left).at(self.of)

    def _mcnb(self, p: np.ndarray) -> Terms:
        n, out, head = len(self.x), Terms(*(np.empty(len(self.x)) for _ in range(3))), []
        if not n:
            return out
        steps = mcnb_steps(self.r[self.rank], p[self.rank], self.top)
        for x, now in zip(range(len(self.x_ends) - 1), steps, strict=False):
            if x <= self.left:
                head.append(now)
                continue
            cells = self.by_x[self.x_ends[x] : self.x_ends[x + 1]]
            for mine, theirs in zip((out.value, out.slope, out.bend), (now.value, now.slope, now.bend), strict=True):
                mine[cells] = theirs[self.place[cells]]
        mass = _truncation(*(np.array([getattr(t, c) for t in head]) for c in ("value", "slope", "bend")))
        small = np.flatnonzero(mass.value < np.log(1e-3))
        if len(small):  # one less the head has few digits there, and the terms above fall fast
            far, sound = _mcnb_above(self.r[self.rank][small], p[self.rank][small], self.left)
            at = small[sound]
            mass.value[at], mass.slope[at], mass.bend[at] = far.value[sound], far.slope[sound], far.bend[sound]
        return out - mass.at(self.place)
