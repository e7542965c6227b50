"""Lines of windows: drawn to their neighbours', and evaluated at a problem's mean slice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import settle
from . import diff, fit, score

ALLELE = fit.ALLELE
_LINE = ("b", "mu")
#: Times that each line is moved.
SWEEPS = 30


def _cells(pdf: pd.DataFrame, left: int) -> fit.WindowCells:
    return fit.WindowCells(*(pdf[c].to_numpy(float) for c in ("x", "slice", "n")), left)


def _move(away: np.ndarray, hess: np.ndarray, room: float) -> np.ndarray:
    """The step closest to ``away`` that raises a quadratic with this Hessian by ``room`` at most."""
    size, axes = np.linalg.eigh(hess)
    size, part = np.maximum(size, 0.0), axes.T @ away
    rise = lambda k: float((size * (part / (1 + k * size)) ** 2).sum() / 2)
    if rise(0.0) <= room:
        return away
    low, high = 0.0, 1.0
    while rise(high) > room:
        high *= 4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if rise(mid) > room else (low, mid)
    return axes @ (part / (1 + high * size))


def adjust_lines(oriented: DataFrame, windows: DataFrame, fits: DataFrame, left: int = 4, beta: bool = False, tolerance: float = 1e-6, transform: str = "none", k_max: float = 10_000.0) -> DataFrame:
    """``fits`` (of ``fit.fit_windows`` on ``windows``) whose b and mu are close to those of the windows before and after, with adj_nll.

    Of all lines whose negative log likelihood grows by a share of ``tolerance`` at most, those
    are taken whose steps from window to window, in the order of their centres, have the
    least sum of squares: in turn, each line moves as near to the middle of its neighbours' as
    its likelihood allows. So lines that the data cannot tell apart, as those of a single slice, agree. A step's
    length is that of mu and of b times the (BAD, allele)'s mean slice.

    Only one row a window (its Hessian in b and mu) takes part in the pass in order; how far
    its likelihood really allows the move is checked for all windows at once, and a
    move that goes too far is halved. Lines whose standard errors are zero, as the fixed
    b = 1, mu = 0 of small BADs, stay.
    """
    at = fits.where(F.col("name").isin(*fit.NAMES)).groupBy(*ALLELE, "slice").agg(
        *[F.max(F.when(F.col("name") == c, F.col("est"))).alias(c) for c in fit.NAMES], F.max("nll").alias("nll"), F.min(F.when(F.col("name").isin(*_LINE), F.coalesce("std", F.lit(1.0)))).alias("least_std")
    ).withColumnRenamed("slice", "centre")
    met = oriented.join(windows.select(*ALLELE, "centre", "lo", "hi"), ALLELE).where("slice BETWEEN lo AND hi").select(*ALLELE, "centre", "slice", "x", "n")

    def params(row: pd.Series, b: float, mu: float) -> dict[str, float]:
        known = {c: float(row[c]) if pd.notna(row[c]) else 0.0 for c in fit.NAMES}
        return known | {"b": b, "mu": mu}

    def bend(pdf: pd.DataFrame) -> pd.DataFrame:
        row, cells = pdf.iloc[0], _cells(pdf, left)
        centre = float(np.average(cells.s, weights=cells.n))
        loss = lambda u: cells.nll(params(row, u[0] / centre, u[1]), beta, transform, k_max)
        u = np.array([row["b"] * centre, row["mu"]])
        _, _, hess = fit._derivatives(loss, u, np.full(2, 3e-5 * max(1.0, float(np.abs(u).max()))))
        free = row["least_std"] != 0 and np.isfinite(hess).all()
        return pd.DataFrame([(row["bad"], row["allele"], int(row["centre"]), centre, u[0] / centre, u[1], *([hess[0, 0], hess[0, 1], hess[1, 1]] if free else [np.nan] * 3), row["nll"])], columns=["bad", "allele", "centre", "mean", "b", "mu", "h00", "h01", "h11", "nll"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("centre")
        scale = np.array([max(float(pdf["mean"].mean()), 1.0), 1.0])
        own = pdf[["b", "mu"]].to_numpy(float) * scale
        # each window's Hessian is in its own mean slice
        bends = [np.array([[h0 * f * f, h1 * f], [h1 * f, h2]]) for h0, h1, h2, f in zip(*(pdf[c].to_numpy(float) for c in ("h00", "h01", "h11")), pdf["mean"].to_numpy(float) / scale[0], strict=True)]
        now, room = own.copy(), tolerance / 2 * pdf["nll"].abs().to_numpy(float)  # half, as losses are no parabolas
        for _ in range(SWEEPS if len(own) > 1 else 0):
            for i, bent in enumerate(bends):
                if np.isfinite(bent).all():
                    middle = now[[j for j in (i - 1, i + 1) if 0 <= j < len(own)]].mean(axis=0)
                    now[i] = own[i] + _move(middle - own[i], bent, room[i])
        now = now / scale
        return pd.DataFrame({"bad": pdf["bad"], "allele": pdf["allele"], "centre": pdf["centre"], "to_b": now[:, 0], "to_mu": now[:, 1]})

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        row, cells, share = pdf.iloc[0], _cells(pdf, left), 1.0
        line, step = np.array([row["b"], row["mu"]]), np.array([row["to_b"] - row["b"], row["to_mu"] - row["mu"]])
        loss = lambda s: cells.nll(params(row, *(line + s * step)), beta, transform, k_max)
        own = loss(0.0)
        while share and (now := loss(share)) > own + tolerance * abs(own):
            share = share / 2 if share > 1e-6 else 0.0
        now = now if share else own
        return pd.DataFrame([(row["bad"], row["allele"], int(row["centre"]), *map(float, line + share * step), now)], columns=["bad", "allele", "centre", "b", "mu", "adj_nll"])

    key = "bad double, allele string, centre int"
    rows = met.join(at, [*ALLELE, "centre"])
    bent = rows.groupBy(*ALLELE, "centre").applyInPandas(bend, f"{key}, mean double, b double, mu double, h00 double, h01 double, h11 double, nll double")
    drawn = bent.groupBy(*ALLELE).applyInPandas(walk, f"{key}, to_b double, to_mu double")  # one row a window
    moved = rows.join(drawn, [*ALLELE, "centre"]).groupBy(*ALLELE, "centre").applyInPandas(check, f"{key}, b double, mu double, adj_nll double")
    out = fits.join(moved.withColumnsRenamed({"centre": "slice", "b": "__b", "mu": "__mu"}), [*ALLELE, "slice"])
    est = F.when(F.col("name") == "b", F.col("__b")).when(F.col("name") == "mu", F.col("__mu")).otherwise(F.col("est"))
    return out.withColumn("est", est).drop("__b", "__mu")


def slice_logliks(oriented: DataFrame, params: DataFrame, left: int = 4, dist: str = "nb", out: str = "loglik") -> DataFrame:
    """bad, allele, slice, n and the slice's log likelihood under its mixture ``params`` (bad, allele, slice, r, w, p1, p2, for betanb k)."""
    wanted = ["r", "w", "p1", "p2", *(["k"] if dist == "betanb" else [])]
    rows = oriented.join(params.select(*ALLELE, "slice", *wanted), [*ALLELE, "slice"])
    for side in ("1", "2"):
        rows = score.with_tails(rows, left, dist, f"p{side}", side)
    low, high = F.least("__a", "__b"), F.greatest("__a", "__b")
    rows = rows.withColumns({"__a": F.when(F.col("w") > 0, F.log("w") + F.col("logpmf1")), "__b": F.when(F.col("w") < 1, F.log1p(-F.col("w")) + F.col("logpmf2"))})
    both = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.coalesce("__a", "__b")).otherwise(high + F.log1p(F.exp(low - high)))
    return rows.groupBy(*ALLELE, "slice").agg(F.sum("n").alias("n"), F.sum(F.col("n") * both).alias(out))


def adjusted_logliks(oriented: DataFrame, fits: DataFrame, adjusted: DataFrame, left: int = 4, dist: str = "nb") -> DataFrame:
    """Per slice n, loglik under the nearest window's fit, adj_loglik under its adjusted line, and penalty, what the adjustment takes.

    The adjusted log likelihood is our definition; a slice's may be larger than its plain one, as
    only that of its whole window is kept.
    """
    plain, drawn = (fit.scoring_params(f.select(*ALLELE, "slice", "name", "est"), oriented) for f in (fits, adjusted))
    both = slice_logliks(oriented, plain, left, dist).join(slice_logliks(oriented, drawn, left, dist, "adj_loglik").drop("n"), [*ALLELE, "slice"])
    return both.withColumn("penalty", F.col("loglik") - F.col("adj_loglik"))


def line_params(grouped: DataFrame, keys: list[str], params: DataFrame, left: int = 4) -> DataFrame:
    """keys, allele, group, slice, at, r and k in line mode.

    A problem's parameters are those nearest to the mean of its distinct cells' slices
    (the slice that it rounds to, half to even, else the nearest, the lower one of two):
    r = mu + b * slice ** slice_power and k = mu_k + b_k ln slice, and where there is a weight w
    and BAD is not 1, r is scaled by ``diff.line_adjusted_r``. ``params``: bad, allele, slice, b, mu and,
    if known, slice_power, mu_k, b_k, w.
    """
    sides = F.array(*[F.struct(F.lit(a).alias("allele"), F.col(f"{a}_count").alias("x"), F.col(f"{b}_count").alias("slice")) for a, b in (("ref", "alt"), ("alt", "ref"))])
    problem = [*dict.fromkeys([*keys, "bad"]), "allele", "group"]
    rows = grouped.select(*problem[:-2], "group", F.inline(sides)).withColumn("group", F.explode(F.array("group", F.lit(diff.ALL))))
    # a problem's distinct cells at once, at most as many as there are distinct counts
    cells = rows.groupBy(*problem).agg(F.collect_set(F.struct("x", "slice")).alias("__cells"))
    total = F.aggregate("__cells.slice", F.lit(0).cast("long"), lambda a, v: a + v)
    means = cells.select(*problem, (total / F.size("__cells")).alias("__mean"), F.array_distinct("__cells.slice").alias("__slices"))
    params = settle(params, "lines")
    # for each whole number the fitted slices below and above it: a few numbers a (BAD, allele)
    known = params.groupBy(*ALLELE).agg(F.sort_array(F.collect_set(F.col("slice").cast("int"))).alias("__known"), F.max("slice").cast("int").alias("__top"))
    grid = known.select(*ALLELE, "__known", F.explode(F.sequence(F.lit(0), F.col("__top"))).alias("__floor"))
    below = F.coalesce(F.array_max(F.filter("__known", lambda v: v <= F.col("__floor"))), F.array_min("__known"))
    above = F.coalesce(F.array_min(F.filter("__known", lambda v: v > F.col("__floor"))), F.array_max("__known"))
    grid = grid.select(*ALLELE, "__floor", below.alias("__below"), above.alias("__above"))
    tops = known.select(*ALLELE, "__top")
    at = means.join(F.broadcast(tops), ALLELE).withColumn("__floor", F.least(F.floor("__mean").cast("int"), F.col("__top"))).drop("__top").join(F.broadcast(grid), [*ALLELE, "__floor"])
    whole = F.bround("__mean").cast("int")
    nearest = F.when(F.col("__mean") - F.col("__below") <= F.col("__above") - F.col("__mean"), F.col("__below")).otherwise(F.col("__above"))
    chosen = F.when((whole == F.col("__below")) | (whole == F.col("__above")), whole).otherwise(nearest)
    at = settle(at.select(*problem, chosen.alias("at"), "__slices"), "lines").withColumn("slice", F.explode("__slices")).drop("__slices")
    fields = [c for c in ("b", "mu", "slice_power", "mu_k", "b_k", "w") if c in params.columns]
    # r and k are long expressions of these alone: once each, not once a problem
    met = at.select(*ALLELE, "slice", "at").distinct().join(params.select(*ALLELE, F.col("slice").cast("int").alias("at"), *fields), [*ALLELE, "at"])
    power = F.coalesce("slice_power", F.lit(1.0)) if "slice_power" in fields else F.lit(1.0)
    r = F.col("mu") + F.col("b") * F.pow(F.col("slice").cast("double"), power)
    if "w" in fields:
        r = F.when(F.col("w").isNotNull(), diff.line_adjusted_r(F.col("bad"), r, F.col("w"), left)).otherwise(r)
    k = F.col("mu_k") + F.col("b_k") * F.log("slice") if "mu_k" in fields else F.lit(None).cast("double")
    made = met.select(*ALLELE, "slice", "at", r.alias("r"), k.alias("k"))
    return at.join(F.broadcast(made), [*ALLELE, "slice", "at"]).select(*problem, "slice", "at", "r", "k")
