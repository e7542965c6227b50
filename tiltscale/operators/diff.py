"""Differential tests between groups of scorefiles.

Groups are rows of a membership table, and all groups together are one more group, named
``ALL``. A problem is one (SNV, BAD, allele, group): its distinct cells (x, r, n) are
gathered once - at most as many as there are distinct counts - and its p is fitted. All problems of
one SNV come to a task as one row (``gathered``), so that tests of its groups against all of them need no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import moments, special, truncated
from ..sources.store import read_stage, settle
from . import combine, score

ALL = "__all__"
#: Concentration of the beta negative binomial where there is no fitted one.
DEFAULT_K = 6000.0
SNV = ["chrom", "start", "alt"]
#: Observations of a partition of ``placed``, on average.
ROWS = 50_000


def with_groups(obs: DataFrame, groups: DataFrame, max_cover: int | None = None) -> DataFrame:
    """Observations by group; ``groups`` has one row per (group, scorefile).

    It is sent to all tasks: dealt by scorefile, a few large scorefiles would be a few large tasks.
    """
    out = obs.join(F.broadcast(groups), "scorefile")
    return out.where(F.col("ref_count") + F.col("alt_count") < max_cover) if max_cover else out


def disjoint(groups: DataFrame) -> DataFrame:
    """Scorefiles that more than one group names; a sound table gives none."""
    return groups.groupBy("scorefile").agg(F.count_distinct("group").alias("groups")).where("groups > 1")


def placed(grouped: DataFrame) -> DataFrame:
    """What tests need of ``grouped``, dealt by SNV over as many partitions as there are
    ``ROWS`` observations, so that no task grows with the table. Gates and problems then need no further shuffle."""
    kept = settle(grouped.select(*SNV, "bad", "group", "ref_count", "alt_count"), "observations")
    return kept.repartition(max(1, math.ceil(kept.count() / ROWS)), *SNV)


def gate_samples(grouped: DataFrame, min_samples: int, min_cover: int = 0) -> DataFrame:
    """SNVs of a group with enough replicates and a large enough coverage."""
    own = Window.partitionBy(*SNV, "group")  # in this order, so that the next gate and the problems find the rows sorted
    met = {"__n": F.count("*").over(own), "__c": F.max(F.col("ref_count") + F.col("alt_count")).over(own)}
    return grouped.dropna(subset=["group", *SNV]).withColumns(met).where((F.col("__n") >= min_samples) & (F.col("__c") >= min_cover)).drop(*met)


def gate_groups(grouped: DataFrame, min_groups: int) -> DataFrame:
    return shared_snvs(grouped, SNV, min_groups)


def group_counts(grouped: DataFrame) -> DataFrame:
    """Count tables per (group, BAD) and pooled ones, by grouping sets."""
    key = ["bad", "ref_count", "alt_count"]
    sets = grouped.groupingSets([[*key, "group"], key], *key, "group")
    return sets.agg(F.count("*").alias("n")).withColumn("group", F.coalesce("group", F.lit(ALL)))


def problems(grouped: DataFrame, keys: list[str], params: DataFrame | None = None, dist: str = "nb") -> DataFrame:
    """keys, allele, group and the distinct cells (x, r, n) of each problem, and of all groups together.

    r is the fixed allele's count, or that of ``params`` (bad, allele, slice, r, k), which must
    have every slice; ``fit.scoring_params`` gives such a table. Cells of ``betanb`` also have
    the concentration k, ``DEFAULT_K`` where no fit gives one.
    """
    sides = F.array(*[F.struct(F.lit(a).alias("allele"), F.col(f"{a}_count").alias("x"), F.col(f"{b}_count").alias("slice")) for a, b in (("ref", "alt"), ("alt", "ref"))])
    rows = grouped.select(*dict.fromkeys([*keys, "bad"]), "group", F.inline(sides))
    k = F.lit(DEFAULT_K)
    if params is None:
        rows = rows.withColumn("r", F.col("slice").cast("double"))
    else:
        missing = F.raise_error(F.concat(F.lit("no parameters for "), F.to_json(F.struct("bad", "allele", "slice"))))
        known = [F.col(c).alias(f"__{c}") for c in ("r", "k") if c in params.columns]
        rows = rows.join(F.broadcast(params.select("bad", "allele", "slice", *known)), ["bad", "allele", "slice"], "left")
        rows = rows.withColumn("r", F.when(F.col("__r").isNull(), missing.cast("double")).otherwise(F.col("__r")))
        k = F.coalesce("__k", k) if "k" in params.columns else k
    cell = ["x", "r"]
    if dist == "betanb":
        rows, cell = rows.withColumn("k", k), ["x", "r", "k"]
    both = rows.withColumn("group", F.explode(F.array("group", F.lit(ALL))))
    cells = both.groupBy(*keys, "allele", "group", *cell).agg(F.count("*").alias("n"))
    return cells.groupBy(*keys, "allele", "group").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(*cell, "n"))).alias("cells"))


def gathered(grouped: DataFrame, keys: list[str], params: DataFrame | None = None, dist: str = "nb") -> DataFrame:
    """keys and ``obs``: the distinct observations of all groups, how often each occurs (n), and r (and k) of either allele, as in ``problems``.

    One row holds what all problems of these keys are made of; sides and all groups together are spread in the task.
    """
    at = list(dict.fromkeys([*keys, "bad"]))
    rows = grouped.groupBy(*at, "group", "ref_count", "alt_count").agg(F.count("*").alias("n"))
    fields = ["group", "ref_count", "alt_count", "n"]
    for a, b in (("ref", "alt"), ("alt", "ref")):
        r, k = F.col(f"{b}_count").cast("double"), F.lit(DEFAULT_K)
        if params is not None:
            known = params.where(F.col("allele") == a).select("bad", F.col("slice").alias(f"{b}_count"), *[F.col(c).alias(f"__{c}") for c in ("r", "k") if c in params.columns])
            rows = rows.join(F.broadcast(known), ["bad", f"{b}_count"], "left")
            missing = F.raise_error(F.concat(F.lit("no parameters for "), F.to_json(F.struct("bad", F.lit(a).alias("allele"), F.col(f"{b}_count").alias("slice")))))
            r = F.when(F.col("__r").isNull(), missing.cast("double")).otherwise(F.col("__r"))
            k = F.coalesce("__k", k) if "k" in params.columns else k
        made = {f"{a}_r": r} | ({f"{a}_k": k} if dist == "betanb" else {})
        rows, fields = rows.withColumns(made).drop("__r", "__k"), [*fields, *made]
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("obs"))


#: Where the search for p starts: ten points, of which the best is taken.
GRID = np.linspace(0.01, 0.99, 10)
#: The grid and points between, even in the logit; a root is first found between two of these.
_EVEN = [np.linspace(a, b, 1 + int(np.ceil((b - a) / 0.3)))[:-1] for a, b in zip(np.log(GRID / (1 - GRID))[:-1], np.log(GRID / (1 - GRID))[1:], strict=True)]
NODES = np.append(1 / (1 + np.exp(-np.concatenate(_EVEN))), GRID[-1])
_ON_GRID = np.cumsum([0, *map(len, _EVEN)])


class Tables:
    """Terms of the distinct cells (x, r, k) of a task, of which there are few however many problems there are.

    At ``NODES`` they are kept as they are. At any other p those of ``betanb`` and ``mcnb`` at whole r come from Chebyshev series in
    the logit of p, where x and r are ``FEW`` at most and k is not fitted: so there are few of them, and what a p gives does not depend
    on what was asked before. A panel is ``WIDTH`` of the logit of one cell.
    """

    #: Most cells that are kept from one batch to the next.
    MOST = 40_000
    #: Largest counts with series, width of a panel, the logit where panels begin (they end at its opposite), and points of a panel.
    FEW, WIDTH, FROM, POINTS = 64, 0.25, -6.0, 12

    def __init__(self, dist: str = "nb", left: int = 4) -> None:
        self.dist, self.left = dist, left
        self.at = np.cos(np.pi * (np.arange(self.POINTS) + 0.5) / self.POINTS)
        self.fit = np.linalg.inv(np.polynomial.chebyshev.chebvander(self.at, self.POINTS - 1))
        self.panels = round(-2 * self.FROM / self.WIDTH)
        self.forget()

    def forget(self) -> None:
        self.rows, self.cells, self.terms = {}, np.empty((0, 3)), np.empty((len(NODES), 3, 0))
        self.few, self.place = np.empty(0, bool), np.empty((0, self.panels), np.int32)
        self.series, self.made = np.empty((1024, self.POINTS, 3)), 0

    def at_p(self, rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """value, slope and bend (columns) of cells, by their rows, at a p each; and whether a series gives them, as where none does they are left open."""
        u = np.log(p / (1 - p))
        panel = np.floor((u - self.FROM) / self.WIDTH).astype(np.int64)
        known = np.flatnonzero((panel >= 0) & (panel < self.panels) & self.few[rows])
        code = rows[known] * self.panels + panel[known]
        new = np.unique(code[self.place.ravel()[code] < 0])
        for i in range(0, len(new), 4000):
            self._make(new[i : i + 4000])
        out, inside = np.empty((len(p), 3)), np.zeros(len(p), bool)
        t = 2 * ((u[known] - self.FROM) / self.WIDTH - panel[known]) - 1
        out[known] = np.einsum("gi,gim->gm", np.polynomial.chebyshev.chebvander(t, self.POINTS - 1), self.series[self.place.ravel()[code]])
        inside[known] = True
        return out, inside

    def _make(self, codes: np.ndarray) -> None:
        row, panel = np.divmod(codes, self.panels)
        x, r, k = (np.repeat(c, self.POINTS) for c in self.cells[row].T)
        u = self.FROM + self.WIDTH * (np.repeat(panel, self.POINTS) + (np.tile(self.at, len(codes)) + 1) / 2)
        first, of = truncated.numbered(r, k, u)  # cells of one r and k share all that does not depend on x
        t = truncated.Likelihood(self.dist, x, of, r[first], k[first], self.left).terms(1 / (1 + np.exp(-u[first])))
        values = np.stack([t.value, t.slope, t.bend], axis=1).reshape(len(codes), self.POINTS, 3)
        end = self.made + len(codes)
        if end > len(self.series):
            self.series = np.concatenate([self.series, np.empty((end, self.POINTS, 3))])
        self.series[self.made : end] = np.einsum("ij,gjm->gim", self.fit, values)
        self.place.ravel()[codes] = np.arange(self.made, end)
        self.made = end

    def rows_of(self, x: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The row of each cell in ``terms``, which gets those that are new."""
        first, of = truncated.numbered(x, r, k)
        cells = list(zip(x[first].tolist(), r[first].tolist(), k[first].tolist(), strict=True))
        if len(self.rows) + len(cells) > self.MOST:
            self.forget()
        new = np.array([c not in self.rows for c in cells], bool)
        if new.any():
            at = first[new]
            shared, group = truncated.numbered(r[at], k[at])
            likelihood = truncated.Likelihood(self.dist, x[at], group, r[at][shared], k[at][shared], self.left)
            found = [likelihood.terms(np.full(len(shared), p)) for p in NODES]
            self.rows |= {c: len(self.rows) + i for i, c in enumerate(c for c, n in zip(cells, new, strict=True) if n)}
            self.terms = np.concatenate([self.terms, np.array([(t.value, t.slope, t.bend) for t in found])], axis=2)
            self.cells = np.concatenate([self.cells, np.stack([x[at], r[at], k[at]], axis=1)])
            few = (x[at] <= self.FEW) & (r[at] <= self.FEW) & (r[at] == np.floor(r[at])) & (k[at] == (DEFAULT_K if self.dist == "betanb" else 0))
            self.few = np.concatenate([self.few, few])
            self.place = np.pad(self.place, ((0, len(few)), (0, 0)), constant_values=-1)
        return np.array([self.rows[c] for c in cells], np.int64)[of]


def _between(h: np.ndarray, rise: np.ndarray, g0: np.ndarray, g1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Where, as a share of a step h, the quartic with these ends, slopes b and integral ``rise`` falls through zero (g0 > 0 >= g1)."""
    b0, b1 = b0 * h, b1 * h
    bulge = 30 * (rise / h - (g0 + g1) / 2 - (b0 - b1) / 12)
    lo, hi, t = np.zeros_like(g0), np.ones_like(g0), g0 / (g0 - g1)
    for _ in range(12):
        s = 1 - t
        g = g0 * (1 + 2 * t) * s**2 + b0 * t * s**2 + g1 * t**2 * (3 - 2 * t) - b1 * t**2 * s + bulge * t**2 * s**2
        d = 6 * t * s * (g1 - g0) + b0 * s * (1 - 3 * t) + b1 * t * (3 * t - 2) + 2 * bulge * t * s * (1 - 2 * t)
        lo, hi = np.where(g > 0, t, lo), np.where(g > 0, hi, t)
        step = t - g / d
        t = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
    return t


def _floats(flat: pa.StructArray, field: str) -> np.ndarray:
    return flat.field(field).to_numpy(zero_copy_only=False).astype(float)


class Cells:
    """The cells of many problems, one after the other, under one left-truncated distribution."""

    def __init__(self, lists: pa.ListArray, dist: str = "nb", left: int = 4) -> None:
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()  # of a slice, its own cells
        x, r, n = (_floats(flat, c) for c in ("x", "r", "n"))
        k = _floats(flat, "k") if dist == "betanb" else np.zeros(len(x))
        # cells of a problem with one r and k share all that does not depend on x
        problem = np.repeat(np.arange(len(sizes)), sizes)
        first, of = truncated.numbered(problem, r, k)
        self._set(dist, left, sizes, x, r, k, n, of, problem[first], r[first], k[first])

    def _set(self, dist: str, left: int, sizes: np.ndarray, x: np.ndarray, r: np.ndarray, k: np.ndarray, n: np.ndarray, of: np.ndarray, problem: np.ndarray, own_r: np.ndarray, own_k: np.ndarray) -> None:
        self.dist, self.left, self.sizes, self.x, self.r, self.k, self.n, self.of, self.problem = dist, left, sizes, x, r, k, n, of, problem
        self.starts = np.cumsum(sizes) - sizes
        self.likelihood = truncated.Likelihood(dist, x, of, own_r, own_k, left)
        self.rows = None

    def only(self, which: np.ndarray) -> Cells:
        """The cells of some problems; ``which`` is true for these."""
        out, cells, groups = Cells.__new__(Cells), np.repeat(which, self.sizes), which[self.problem]
        number = np.cumsum(groups) - 1
        out._set(
            self.dist, self.left, self.sizes[which], self.x[cells], self.r[cells], self.k[cells], self.n[cells],
            number[self.of[cells]], (np.cumsum(which) - 1)[self.problem[groups]], self.likelihood.r[groups], self.likelihood.k[groups],
        )
        out.rows = None if self.rows is None else self.rows[cells]
        return out

    def spread(self, p: np.ndarray) -> np.ndarray:
        return np.repeat(p, self.sizes)

    def total(self, each: np.ndarray) -> np.ndarray:
        """Sums by problem; every problem has a cell."""
        return np.add.reduceat(each, self.starts) if len(each) else np.zeros(len(self.sizes))

    def terms(self, p: np.ndarray) -> truncated.Terms:
        """Of each cell, seen once, at its problem's p, without terms free of p."""
        return self.likelihood.terms(p[self.problem])

    def terms_by(self, tables: Tables, p: np.ndarray) -> truncated.Terms:
        """``terms``, from series of ``tables`` where it has them; ``rows`` are the cells' rows there."""
        if self.dist == "nb":  # whose terms cost no more than their series
            return self.terms(p)
        out, known = tables.at_p(self.rows, self.spread(p))
        if not known.all():
            own, of = np.unique(self.of[~known], return_inverse=True)
            rest = truncated.Likelihood(self.dist, self.x[~known], of, self.likelihood.r[own], self.likelihood.k[own], self.left).terms(p[self.problem[own]])
            out[~known] = np.stack([rest.value, rest.slope, rest.bend], axis=1)
        return truncated.Terms(*out.T)

    def nll(self, p: np.ndarray, tables: Tables | None = None) -> np.ndarray:
        return -self.total(self.n * (self.terms(p) if tables is None else self.terms_by(tables, p)).value)

    def _start(self, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each problem's p, and a p between them: from the best point of the grid to
        the next root of the score, as nodes and a quartic between two of them have it."""
        rows = self.rows = tables.rows_of(self.x, self.r, self.k)
        value, slope, bend = np.array([[self.total(self.n * t[rows]) for t in at] for at in tables.terms]).transpose(1, 0, 2)
        best = np.nanargmin(-value[_ON_GRID], axis=0)
        edges = np.concatenate([[1e-12], GRID, [1 - 1e-12]])
        lo, hi, p = edges[best], edges[best + 2], GRID[best]
        q = (NODES * (1 - NODES))[:, None]
        bend = bend * q**2 + slope * q * (1 - 2 * NODES)[:, None]
        slope = slope * q  # both in the logit from here
        at, who = _ON_GRID[best], np.arange(len(p))
        up = slope[at, who] > 0
        fell = (slope[:-1] > 0) & (slope[1:] <= 0)
        last = len(NODES) - 2
        left = np.where(up, at, at - 1)  # a root lies between this node and the next
        for _ in range(int(np.diff(_ON_GRID).max())):
            inside = (left >= 0) & (left <= last)
            left = np.where(inside & ~fell[np.clip(left, 0, last), who], np.where(up, left + 1, left - 1), left)
        j = np.clip(left, 0, last)
        met = fell[j, who] & (left == j) & (NODES[j] >= lo) & (NODES[j + 1] <= hi)
        j, w = j[met], who[met]
        u = np.log(NODES / (1 - NODES))
        h = u[j + 1] - u[j]
        with np.errstate(all="ignore"):
            t = u[j] + h * _between(h, value[j + 1, w] - value[j, w], slope[j, w], slope[j + 1, w], bend[j, w], bend[j + 1, w])
        lo[met], hi[met], p[met] = NODES[j], NODES[j + 1], np.clip(1 / (1 + np.exp(-t)), NODES[j], NODES[j + 1])
        return lo, hi, p

    def mle(self, rounds: int = 100, newton: int = 25, tables: Tables | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """p of each problem, its nll, its variance by Fisher information and by the sandwich.

        All problems search at once: a grid of ten points, then the root of the score
        between the best point's neighbours (zero and one beyond the ends) by Newton's
        steps in the logit, by halving where these leave the bracket. Terms come
        from ``tables``; a problem whose step is below 1e-9 is not looked at again. Variances
        are null (nan) where the information is not positive or p is at an end, 1e-12 from zero or one.
        """
        low, high = 1e-12, 1 - 1e-12
        if not len(self.sizes):
            return (np.zeros(0),) * 4
        tables = tables or Tables(self.dist, self.left)
        lo, hi, p = self._start(tables)
        nll, info, meat = (np.empty(len(p)) for _ in range(3))
        active, cells = np.arange(len(p)), self
        for k in range(rounds):
            t, now, a, b = cells.terms_by(tables, p[active]), p[active], lo[active], hi[active]
            slope, bend = cells.total(cells.n * t.slope), cells.total(cells.n * t.bend)
            with np.errstate(over="ignore"):
                nll[active], info[active], meat[active] = -cells.total(cells.n * t.value), -bend, cells.total(cells.n * t.slope**2)
            a, b, q = np.where(slope > 0, now, a), np.where(slope < 0, now, b), now * (1 - now)
            with np.errstate(all="ignore"):
                move = -slope / (bend * q + slope * (1 - 2 * now))
                grown = now * np.exp(move)
                step = grown / (1 - now + grown)
                sound = (bend * q + slope * (1 - 2 * now) < 0) & (step > a) & (step < b) & (k < newton)
            still = (slope == 0) | (np.abs(move) < 1e-9)
            step = np.where(slope == 0, now, np.where(sound, step, np.where(still & np.isfinite(move), now, (a + b) / 2)))
            lo[active], hi[active], p[active] = a, b, step
            going = ~still & (np.abs(step - now) > 4e-16 * step + 1e-18)
            if not going.any():
                break
            if not going.all():
                cells, active = cells.only(going), active[going]
        p = np.where(p < low * 2, low, np.where(p > 1 - 2e-12, high, p))
        sound = (info > 0) & (p > low) & (p < high)
        info = np.where(sound, info, 1)
        with np.errstate(over="ignore"):
            return p, nll, np.where(sound, 1 / info, np.nan), np.where(sound, meat / info**2, np.nan)


class Families:
    """The problems of a batch of ``gathered`` rows: those of one row and allele are a family, all groups together its last.

    ``cells`` are the problems' cells in the order of ``problems``; ``row``, ``allele`` and ``group`` (a number in ``names``,
    that of all groups the last) name each problem, ``pooled`` is the place of its family's last.
    """

    def __init__(self, lists: pa.ListArray, dist: str = "nb", left: int = 4) -> None:
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        named = flat.field("group").dictionary_encode("encode")
        self.names = [*named.dictionary.to_pylist(), ALL]
        group, count = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(self.names)
        both = lambda end: np.tile(np.concatenate([_floats(flat, f"{a}_{end}") for a in ("ref", "alt")]), 2)
        x, r = both("count"), both("r")
        k = both("k") if dist == "betanb" else np.zeros(len(x))
        m = len(group)
        family = np.tile(np.repeat(np.arange(len(sizes)), sizes), 4) * 2 + np.tile(np.repeat([0, 1], m), 2)
        problem = family * count + np.concatenate([group, group, np.full(2 * m, count - 1)])
        # cells in the order of problem, x, r and k, each once
        (_, shape), (_, at) = truncated.numbered(r, k) if dist == "betanb" else truncated.numbered(r), truncated.numbered(x)
        shapes = int(shape.max(initial=0)) + 1
        code = (problem * (int(at.max(initial=0)) + 1) + at) * shapes + shape
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        one = order[starts]
        n = np.add.reduceat(np.tile(_floats(flat, "n"), 4)[order], starts) if m else np.zeros(0)
        own, sizes = np.unique(problem[one], return_counts=True)
        number = np.repeat(np.arange(len(own)), sizes)
        # cells of a problem with one r and k share all that does not depend on x
        first, of = truncated.numbered(number * shapes + shape[one])
        x, r, k = x[one], r[one], k[one]
        self.cells = Cells.__new__(Cells)
        self.cells._set(dist, left, sizes, x, r, k, n, of, number[first], r[first], k[first])
        self.row, self.allele, self.group = own // count // 2, own // count % 2, own % count
        self.apart = self.group < count - 1
        self.pooled = np.searchsorted(own // count, own // count, "right") - 1


def _with_columns(batch: pa.RecordBatch, drop: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """``batch`` without one column and with new ones; nan is null."""
    kept = [c for c in batch.schema.names if c != drop]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(v, from_pandas=True) for v in columns.values()]], [*kept, *columns])


@lru_cache(4)
def _tables(dist: str, left: int) -> Tables:
    """A worker keeps these, of bounded size, from one task to the next."""
    return Tables(dist, left)


@lru_cache(4)
def _panels(dist: str, left: int) -> moments.Panels:
    return moments.Panels(dist, left)


#: Cells that are worked on at a time, as few as caches hold; more where terms come from series, as the last few problems of a part cost most calls.
TOGETHER, TOGETHER_SERIES = 25_000, 100_000


def _parts(batch: pa.RecordBatch, lists: str = "cells", together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """A batch of problems in parts of about ``together`` cells."""
    ends = batch.column(lists).offsets.to_numpy().astype(np.int64)
    part = (ends[:-1] - ends[0]) // together
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(a, b - a)


def fit_p(table: DataFrame, left: int = 4, dist: str = "nb", cells: bool = False) -> DataFrame:
    """``problems`` with p, nll, var and var_sandwich, under ``dist``: nb, betanb or mcnb; without the cells unless they are to stay."""
    drop = "" if cells else "cells"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != drop) + ", p double, nll double, var double, var_sandwich double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(dist, left)
        for batch in (part for whole in batches for part in _parts(whole)):
            found = Cells(batch.column("cells"), dist, left).mle(tables=tables)
            yield _with_columns(batch, drop, dict(zip(("p", "nll", "var", "var_sandwich"), found, strict=True)))

    return table.mapInArrow(solve, schema)


def fit_groups(grouped: DataFrame, keys: list[str], params: DataFrame | None = None, dist: str = "nb", left: int = 4, against: bool = False, effect: str | None = None) -> DataFrame:
    """keys, allele, group, n, p, nll, var and var_sandwich of all problems of ``grouped``, in one pass without joins.

    ``against`` adds p_all, the p of all groups, and at, the group's nll there; ``effect``, entropy or
    mean, what ``entropy_effect`` or ``mean_effect`` gives. Of all groups together these are null.
    """
    table = gathered(grouped, keys, params, dist)
    made = ["p", "nll", "var", "var_sandwich", *(["p_all", "at"] if against else []), *(EFFECTS[effect][0].split() if effect else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "obs") + ", allele string, group string, n long" + "".join(f", {c} double" for c in made)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, panels = _tables(dist, left), _panels(dist, left)
        for batch in (part for whole in batches for part in _parts(whole, "obs", (TOGETHER if dist == "nb" else TOGETHER_SERIES) // 4)):
            all_of = Families(batch.column("obs"), dist, left)
            found = list(all_of.cells.mle(tables=tables))
            apart, own, both = all_of.apart, found[0], found[0][all_of.pooled]

            def spread(values: np.ndarray, apart: np.ndarray = apart) -> np.ndarray:
                out = np.full(len(apart), np.nan)
                out[apart] = values
                return out

            if against or effect:
                cells = all_of.cells.only(apart)
            if against:
                found += [spread(both[apart]), spread(cells.nll(both[apart], tables))]
            if effect:
                at = [panels.at(cells.likelihood, p[apart][cells.problem]) for p in (own, both)]
                found += [spread(e) for e in EFFECTS[effect][1](cells, *at)]
            row, names = pa.array(all_of.row), pa.array(all_of.names, pa.string())
            columns = [batch.column(c).take(row) for c in batch.schema.names if c != "obs"]
            columns += [pa.array(["ref", "alt"]).take(pa.array(all_of.allele)), names.take(pa.array(all_of.group)), pa.array(all_of.cells.total(all_of.cells.n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, from_pandas=True) for v in found]], [*[c for c in batch.schema.names if c != "obs"], "allele", "group", "n", *made])

    return table.mapInArrow(solve, schema)


def against_all(fits: DataFrame, keys: list[str]) -> DataFrame:
    """``pairwise`` of ``fit_groups`` with ``against``."""
    return _moved(fits.where(F.col("group") != ALL).withColumnRenamed("nll", "own"), keys)


def _moved(rows: DataFrame, keys: list[str]) -> DataFrame:
    stat = F.greatest(2 * (F.col("at") - F.col("own")), F.lit(0.0))
    return rows.select(*keys, "allele", "group", "n", "p", "p_all", F.coalesce(special.chi2_sf(stat, 1), F.lit(1.0)).alias("pval"))


def lrt(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Likelihood ratio of groups against one p: statistic, groups and pval; needs two groups."""
    own = F.col("group") != ALL
    out = fits.groupBy(*keys, "allele").agg(
        F.sum(F.when(own, F.col("nll"))).alias("apart"), F.max(F.when(~own, F.col("nll"))).alias("together"), F.count(F.when(own, 1)).alias("groups"), F.max(F.when(~own, F.col("p"))).alias("p_all"), F.max(F.when(~own, F.col("n"))).alias("n_all")
    ).where("groups >= 2")
    stat = F.greatest(2 * (F.col("together") - F.col("apart")), F.lit(0.0))
    return out.select(*keys, "allele", "groups", "n_all", "p_all", stat.alias("stat")).withColumn("pval", special.chi2_sf(F.col("stat"), (F.col("groups") - 1).cast("double")))


def pairwise(fits: DataFrame, cells: DataFrame, keys: list[str], left: int = 4, dist: str = "nb") -> DataFrame:
    """Each group's own p against the p of all groups, on the group's cells; an undefined test gives 1."""
    pooled = fits.where(F.col("group") == ALL).select(*keys, "allele", F.col("p").alias("p_all"))
    rows = cells.where(F.col("group") != ALL).join(fits.select(*keys, "allele", "group", "p", F.col("nll").alias("own")), [*keys, "allele", "group"]).join(pooled, [*keys, "allele"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "cells") + ", at double"

    def at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            pooled = batch.column("p_all").to_numpy(zero_copy_only=False)
            yield _with_columns(batch, "cells", {"at": Cells(batch.column("cells"), dist, left).nll(pooled)})

    return _moved(rows.mapInArrow(at, schema), keys)


def lrt_pair(fits: DataFrame, keys: list[str], control: str, test: str) -> DataFrame:
    """The likelihood ratio test of two groups with both groups' p and n, in the columns of ``wald``."""
    sides = [fits.where(F.col("group") == g).select(*keys, "allele", F.col("n").alias(f"n_{c}"), F.col("p").alias(f"p_{c}"), F.sqrt("var").alias(f"std_{c}")) for g, c in ((control, "control"), (test, "test"))]
    return lrt(fits.where(F.col("group").isin(control, test, ALL)), keys).select(*keys, "allele", "p_all", "pval").join(sides[0], [*keys, "allele"]).join(sides[1], [*keys, "allele"])


def stored_groups(spark: SparkSession, path: str) -> DataFrame:
    """group and scorefile of the named sets of a stage table of members, as earlier combines stored them; the default set is no group."""
    return read_stage(spark, path).where("subname IS NOT NULL").select(F.col("subname").alias("group"), "scorefile").distinct()


def require_disjoint(groups: DataFrame) -> DataFrame:
    """``groups``, if no scorefile is in two of them; else an error."""
    if both := disjoint(groups).limit(5).collect():
        raise ValueError(f"scorefiles in more than one group: {[r.scorefile for r in both]}")
    return groups


def logit_delta(p: Column, var: Column) -> tuple[Column, Column]:
    """logit p and its variance by the delta method."""
    return F.log(p / (1 - p)), var * F.pow(1 / p + 1 / (1 - p), 2)


def wald(fits: DataFrame, keys: list[str], control: str, test: str, contrast: tuple[float, float, float] = (1, -1, 0), var: str = "var", logit: bool = False) -> DataFrame:
    """Two-sided normal test of a * p_control + b * p_test + c.

    A variance is at most (1 - p) squared. Where one is undefined, or both are zero, there
    is no test and p is 1.
    """
    a, b, c = contrast
    sides = []
    for g, name in ((control, "control"), (test, "test")):
        p, v = F.col("p"), F.col(var)
        v = F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(0.0)), F.pow(1 - p, 2)))
        raw = v
        if logit:
            p, v = logit_delta(p, v)
        sides.append(fits.where(F.col("group") == g).select(*keys, "allele", F.col("n").alias(f"n_{name}"), F.col("p").alias(f"p_{name}"), p.alias(f"v_{name}"), v.alias(f"var_{name}"), raw.alias(f"raw_{name}")))
    both = sides[0].join(sides[1], [*keys, "allele"])
    spread = a * a * F.col("var_control") + b * b * F.col("var_test")
    z = F.try_divide(F.abs(a * F.col("v_control") + b * F.col("v_test") + c), F.sqrt(spread))
    sound = (F.col("raw_control") + F.col("raw_test") > 0) & z.isNotNull() & ~F.isnan(z)
    pval = F.when(sound, 2 * special.norm_sf(F.coalesce(z, F.lit(0.0)))).otherwise(1.0)
    return both.select(*keys, "allele", "n_control", "n_test", "p_control", "p_test", F.sqrt("raw_control").alias("std_control"), F.sqrt("raw_test").alias("std_test"), pval.alias("pval"))


def alleles_wide(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key with ref_ and alt_ columns."""
    side = lambda a: df.where(F.col("allele") == a).select(*keys, *[F.col(f).alias(f"{a}_{f}") for f in fields])
    return side("ref").join(side("alt"), keys)


def derived(wide: DataFrame) -> DataFrame:
    """Effect sizes between the groups, preferred alleles and the selected allele's values."""
    for a in ("ref", "alt"):
        pc, pt = F.col(f"{a}_p_control"), F.col(f"{a}_p_test")
        wide = wide.withColumn(f"{a}_es_p", F.log2(pt) - F.log2(pc)).withColumn(f"{a}_es_logit", (F.log2(pt) - F.log1p(-pt)) - (F.log2(pc) - F.log1p(-pc)))
    for g in ("control", "test"):
        wide = wide.withColumn(f"pref_allele_{g}", F.when(F.col(f"ref_p_{g}") > F.col(f"alt_p_{g}"), "ref").otherwise("alt"))
    ref = F.col("ref_pval") < F.col("alt_pval")
    wide = wide.withColumn("scoring_model", F.when(ref, "ref|alt").otherwise("alt|ref"))
    chosen = [f for f in ("es_p", "es_logit", "pval", "fdr_pval") if f"ref_{f}" in wide.columns]
    return wide.withColumns({f: F.when(ref, F.col(f"ref_{f}")).otherwise(F.col(f"alt_{f}")) for f in chosen})


def anova_wide(tests: DataFrame, pairs: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """One row per key: n and, by group and allele, p, pairwise p-values and what else of
    fdr_pval, es and es_var ``pairs`` has; and the test of all groups."""
    out = alleles_wide(tests, keys, ["pval", "p_all", "n_all"])
    fields = [f for f in ("p", "pval", "fdr_pval", "es", "es_var") if f in pairs.columns]
    cells = pairs.groupBy(*keys).pivot("group", groups)
    per = cells.agg(*[F.max(F.when(F.col("allele") == a, F.col(f))).alias(f"{a}_{f}") for a in ("ref", "alt") for f in fields], F.max("n").alias("n"))
    return out.join(per, keys)


def _entropy(c: Cells, own: moments.Moments, both: moments.Moments) -> tuple[np.ndarray, np.ndarray]:
    n = c.total(c.n)
    return c.total(c.n * (own.first - both.first)[c.of]) / n, c.total(c.n * (own.variance + both.variance)[c.of]) / n**2


def _mean(c: Cells, own: moments.Moments, both: moments.Moments) -> tuple[np.ndarray]:
    with np.errstate(all="ignore"):
        each = np.log2(own.mean) - np.log2(both.mean)
    return (c.total(c.n * np.where(np.isfinite(each), each, np.nan)[c.of]) / c.total(c.n),)


#: Effect sizes: their columns, and these from cells and the moments under the group's p and under all groups' p.
EFFECTS = {"entropy": ("es es_var", _entropy), "mean": ("es", _mean)}


def _effects(fits: DataFrame, cells: DataFrame, keys: list[str], left: int, dist: str, name: str) -> DataFrame:
    """keys, allele, group and what an effect makes of the moments under the group's p and under all groups' p."""
    names, effect = EFFECTS[name]
    pooled = fits.where(F.col("group") == ALL).select(*keys, "allele", F.col("p").alias("p_all"))
    rows = cells.where(F.col("group") != ALL).join(fits.select(*keys, "allele", "group", "p"), [*keys, "allele", "group"]).join(pooled, [*keys, "allele"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "cells") + "".join(f", {c} double" for c in names.split())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panels = _panels(dist, left)
        for batch in (part for whole in batches for part in _parts(whole)):
            c = Cells(batch.column("cells"), dist, left)
            own, both = (panels.at(c.likelihood, batch.column(p).to_numpy(zero_copy_only=False)[c.problem]) for p in ("p", "p_all"))
            yield _with_columns(batch, "cells", dict(zip(names.split(), effect(c, own, both), strict=True)))

    return rows.mapInArrow(solve, schema).select(*keys, "allele", "group", *names.split())


def entropy_effect(fits: DataFrame, cells: DataFrame, keys: list[str], left: int = 4, dist: str = "nb") -> DataFrame:
    """Mean over observations of E[log2 X] under the group's p less that under all groups' p, and its variance."""
    return _effects(fits, cells, keys, left, dist, "entropy")


def mean_effect(fits: DataFrame, cells: DataFrame, keys: list[str], left: int = 4, dist: str = "nb") -> DataFrame:
    """Mean over observations of log2 of the truncated mean under the group's p less that under all groups' p.

    A beta negative binomial whose mean is infinite ((1 - p) k at most one) gives null.
    """
    return _effects(fits, cells, keys, left, dist, "mean")


def line_adjusted_r(bad: Column, r: Column, w: Column, left: int = 4) -> Column:
    """r scaled by m1 / (w * m1 + (1 - w) * m2), the truncated NB means of both modes; unchanged at BAD 1."""
    m1, m2 = score.nb_mean(r, bad / (bad + 1), left), score.nb_mean(r, 1 / (bad + 1), left)
    return F.when(bad != 1, r * m1 / (w * m1 + (1 - w) * m2)).otherwise(r)


#: Columns of both alleles in a table of difference tests.
TESTED = ["n_control", "n_test", "p_control", "p_test", "std_control", "std_test", "pval"]


def solve(grouped: DataFrame, keys: list[str], params: DataFrame | None = None, dist: str = "nb", left: int = 4) -> tuple[DataFrame, DataFrame]:
    """Fits of all problems of ``grouped``, written, as tests use them more than once; and their cells, which are not."""
    return settle(fit_groups(grouped, keys, params, dist, left), "fits"), problems(grouped, keys, params, dist)


def shared_snvs(grouped: DataFrame, keys: list[str], groups: int = 2) -> DataFrame:
    """Observations of keys (SNVs in one BAD) that so many groups have."""
    met = F.size(F.collect_set("group").over(Window.partitionBy(*keys)))
    return grouped.dropna(subset=keys).withColumn("__k", met).where(F.col("__k") >= groups).drop("__k")


def count_effect(grouped: DataFrame, control: str, test: str, keys: list[str] = SNV) -> DataFrame:
    """es_count: the mean of log2 alt / ref over the test group's observations less that over the control's."""
    ratio = F.log2("alt_count") - F.log2("ref_count")
    mean = lambda g: F.avg(F.when(F.col("group") == g, ratio))
    return grouped.groupBy(*keys).agg((mean(test) - mean(control)).alias("es_count"))


def difftest(grouped: DataFrame, control: str, test: str, params: DataFrame | None = None, dist: str = "nb", method: str = "wald", **options) -> DataFrame:
    """Tests of two groups' observations: one row per SNV and BAD that both have, with both
    alleles' results, their false discovery rates, the derived columns and es_count.

    ``grouped``: ``with_groups`` of disjoint groups. ``method``: wald (``options`` are those
    of ``wald``) or lrt. ``params`` and ``dist`` are those of ``problems``.
    """
    keys = [*SNV, "bad"]
    both = shared_snvs(placed(grouped.where(F.col("group").isin(control, test))), keys)
    fits, _ = solve(both, keys, params, dist)
    found = lrt_pair(fits, keys, control, test) if method == "lrt" else wald(fits, keys, control, test, **options)
    wide = alleles_wide(found, keys, TESTED)
    for a in ("ref", "alt"):
        wide = combine.fdr(wide, f"{a}_pval", f"{a}_fdr_pval")
    return derived(wide).join(count_effect(both, control, test), SNV)


def anova(grouped: DataFrame, groups: list[str], min_samples: int = 2, min_groups: int = 2, min_cover: int = 0, params: DataFrame | None = None, dist: str = "nb", effect: str = "entropy") -> DataFrame:
    """Test of several groups: one row per SNV and BAD, with each group's p, test against all
    groups' p and effect size (``effect``: entropy or mean), and false discovery rates."""
    keys = [*SNV, "bad"]
    kept = gate_groups(gate_samples(placed(grouped.where(F.col("group").isin(groups))), min_samples, min_cover), min_groups)
    fits = settle(fit_groups(kept, keys, params, dist, against=True, effect=effect), "fits")
    own = fits.where(F.col("group") != ALL)
    sizes = own.select(*keys, "allele", "group", *EFFECTS[effect][0].split())
    pairs = combine.fdr(against_all(fits, keys), "pval", "fdr_pval", by=["group", "allele"]).join(sizes, [*keys, "allele", "group"])
    wide = anova_wide(lrt(fits, keys), pairs, keys, groups)
    for a in ("ref", "alt"):
        wide = combine.fdr(wide, f"{a}_pval", f"{a}_fdr_pval")
    return wide
