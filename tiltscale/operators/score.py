"""Left-truncated count distributions, mixture scores and binomial tests.

Tails of the negative binomial are incomplete beta functions, so they hold for counts of
any size and small tails keep their digits. The other distributions have a support table:
log probabilities by a running sum of log ratios, as far as the largest count needs. Scores
depend only on distinct (bad, counts), so all this stays small however many observations
there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def log_ratio(dist: str, x: Column) -> Column:
    """log P(x + 1) - log P(x), from columns p, r and k (or n for the binomials)."""
    p, r, k, n = (F.col(c) for c in "prkn")
    a, b = p * k, (1 - p) * k
    return F.log(
        {
            "nb": lambda: p * (x + r) / (x + 1),
            "betanb": lambda: (x + r) * (x + a) / ((x + 1) * (x + a + b + r)),
            "binom": lambda: (n - x) / (x + 1) * p / (1 - p),
            "betabinom": lambda: (n - x) / (x + 1) * (x + a) / (n - x - 1 + b),
        }[dist]()
    )


def log_start(dist: str) -> Column:
    """log P(0)."""
    p, r, k, n = (F.col(c) for c in "prkn")
    a, b = p * k, (1 - p) * k
    return {
        "nb": lambda: r * F.log1p(-p),
        "betanb": lambda: special.lbeta(a, b + r) - special.lbeta(a, b),
        "binom": lambda: n * F.log1p(-p),
        "betabinom": lambda: special.lbeta(a, b + n) - special.lbeta(a, b),
    }[dist]()


def support(params: DataFrame, keys: list[str], dist: str, top: int | Column) -> DataFrame:
    """keys, parameters, x from 0 to ``top`` and logpmf (not truncated)."""
    have = set(params.columns)
    for c in "prkn":
        if c not in have:
            params = params.withColumn(c, F.lit(None).cast("double"))
    top = top if isinstance(top, Column) else F.lit(top)
    rows = params.withColumn("x", F.explode(F.sequence(F.lit(0), top.cast("int"))))
    w = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ratio", log_ratio(dist, F.col("x"))).withColumn("logpmf", log_start(dist) + F.coalesce(F.sum("ratio").over(w), F.lit(0.0))).drop("ratio")


def truncated(table: DataFrame, keys: list[str], left: int, bounded: bool = False) -> DataFrame:
    """Given x > left: pmf, logpmf and sf = P(X >= x), and for a bounded support the mean.

    ``bounded``: the table holds the whole support, and tails are sums from its far end.
    Else sf is one less the lower sum, wherever the table ends.
    """
    up = Window.partitionBy(*keys)
    ahead = up.orderBy("x").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = up.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    raw = F.exp("logpmf")
    rows = table.withColumn("__raw", raw).withColumn("__in", F.when(F.col("x") > left, raw).otherwise(0.0))
    if bounded:
        rows = rows.withColumn("__mass", F.sum("__in").over(up))
        rows = rows.withColumn("mean", F.sum(F.col("__in") * F.col("x")).over(up) / F.col("__mass"))
        sf = F.sum("__in").over(ahead) / F.col("__mass")
    else:
        rows = rows.withColumn("__mass", 1 - F.sum(F.when(F.col("x") <= left, F.col("__raw")).otherwise(0.0)).over(up))
        sf = F.greatest(1 - F.coalesce(F.sum("__in").over(before), F.lit(0.0)) / F.col("__mass"), F.lit(0.0))
    out = rows.withColumn("pmf", F.col("__in") / F.col("__mass")).withColumn("sf", F.when(F.col("x") == left + 1, 1.0).otherwise(sf)).withColumn("logpmf", F.col("logpmf") - F.log("__mass"))
    return out.where(F.col("x") > left).drop("__raw", "__in", "__mass")


def nb_head(r: Column, p: Column, left: int) -> tuple[Column, Column]:
    """Probability of x <= left under the negative binomial, and the sum of x times it."""
    term = head = F.exp(r * F.log1p(-p))
    first = F.lit(0.0)
    for i in range(left):
        term = term * p * (r + i) / (i + 1)
        head, first = head + term, first + term * (i + 1)
    return head, first


def nb_mean(r: Column, p: Column, left: int) -> Column:
    """Mean of the negative binomial given x > left."""
    head, first = nb_head(r, p, left)
    return (r * p / (1 - p) - first) / (1 - head)


def with_tails(rows: DataFrame, left: int = 4, dist: str = "nb", p: str = "p", suffix: str = "") -> DataFrame:
    """``rows`` (x, r, the column ``p``, for betanb k) with logpmf, sf = P(X >= x) and mean, given x > left.

    Counts of any size are scored; for x <= left sf is one and logpmf null.
    """
    out = [f"{c}{suffix}" for c in ("logpmf", "sf", "mean")]
    if dist == "betanb":
        return _beta_nb_tails(rows, left, p, out)
    x, r, q = F.col("x").cast("double"), F.col("r"), F.col(p)
    mass = special.betainc(F.lit(left + 1.0), r, q)
    logpmf = special.lgamma(x + r) - special.lgamma(r) - special.lgamma(x + 1) + x * F.log(q) + r * F.log1p(-q)
    first = nb_head(r, q, left)[1]
    rows = rows.withColumn("__mass", mass).withColumn("__sf", special.betainc(F.greatest(x, F.lit(1.0)), r, q))
    inside = F.col("x") > left
    return rows.withColumns({
        out[0]: F.when(inside, logpmf - F.log("__mass")),
        out[1]: F.when(F.col("x") > left + 1, F.least(F.col("__sf") / F.col("__mass"), F.lit(1.0))).otherwise(1.0),
        out[2]: (r * q / (1 - q) - first) / F.col("__mass"),
    }).drop("__mass", "__sf")


def _beta_nb_tails(rows: DataFrame, left: int, p: str, out: list[str]) -> DataFrame:
    """Each distinct (r, p, k) has one support table, twice as long as its largest x.

    A tail is one less the lower sum; where that has few digits it is the sum above, with
    the power law's remainder beyond the table.
    """
    keys = ["r", "p", "k"]
    tops = rows.groupBy("r", F.col(p).alias("p"), "k").agg(F.greatest(F.max("x"), F.lit(left + 1)).alias("top"))
    table = support(tops, keys, "betanb", 2 * F.col("top") + 100).drop("n")
    up = Window.partitionBy(*keys)
    raw, a, b = F.exp("logpmf"), F.col("p") * F.col("k"), (1 - F.col("p")) * F.col("k")
    inside, low = F.col("x") > left, F.when(F.col("x") <= left, raw).otherwise(0.0)
    beyond = F.max_by(raw * F.col("x"), F.col("x")).over(up) / b
    table = table.withColumn("__head", F.sum(low).over(up)).withColumn("__first", F.sum(low * F.col("x")).over(up)).withColumn("__beyond", beyond)
    in_order = up.orderBy("x")
    lower = F.coalesce(F.sum(F.when(inside, raw).otherwise(0.0)).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upper = F.sum(raw).over(in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)) + F.col("__beyond")
    mass = 1 - F.col("__head")
    sf = F.when(1 - lower / mass > 1e-6, 1 - lower / mass).otherwise(F.least(upper / mass, F.lit(1e-6)))
    mean = F.when(b > 1, (F.col("r") * a / (b - 1) - F.col("__first")) / mass).otherwise(float("inf"))
    table = table.select(
        F.col("r").alias("__r"), F.col("p").alias("__p"), F.col("k").alias("__k"), F.col("x").alias("__x"),
        F.when(inside, F.col("logpmf") - F.log(mass)).alias(out[0]), F.when(F.col("x") > left + 1, sf).otherwise(1.0).alias(out[1]), mean.alias(out[2]),
    )
    met = (F.col("r") == F.col("__r")) & (F.col(p) == F.col("__p")) & (F.col("k") == F.col("__k")) & (F.col("x") == F.col("__x"))
    return rows.join(table, met, "left").drop("__r", "__p", "__k", "__x")


def mcnb(rows: DataFrame, keys: list[str], left: int = 4) -> DataFrame:
    """Left-truncated marginalised compound negative binomial at ``rows`` (keys, x, whole r, p): pmf and sf.

    x given m is negative binomial (m, p) and m is binomial (r, 1 - p) without zero; a
    definition recalled from the literature, so no claim of equality with another program.
    """
    latent = rows.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("r").cast("int")))).withColumn("m", F.col("m").cast("double"))
    logw = special.lgamma(F.col("r") + 1) - special.lgamma(F.col("m") + 1.0) - special.lgamma(F.col("r") - F.col("m") + 1) + F.col("m") * F.log1p(-F.col("p")) + (F.col("r") - F.col("m")) * F.log("p")
    x, m, p = F.col("x").cast("double"), F.col("m"), F.col("p")
    logpmf = special.lgamma(x + m) - special.lgamma(m) - special.lgamma(x + 1) + x * F.log(p) + m * F.log1p(-p)
    parts = latent.withColumn("__sf", special.betainc(F.greatest(x, F.lit(1.0)), m, p)).withColumn("__mass", special.betainc(F.lit(left + 1.0), m, p)).withColumn("__w", F.exp(logw))
    mixed = parts.groupBy(*keys, "x").agg(*[F.sum(F.col("__w") * v).alias(n) for n, v in (("__pmf", F.exp(logpmf)), ("__tail", F.col("__sf")), ("__total", F.col("__mass")))])
    inside = F.col("x") > left
    return mixed.select(*keys, "x", F.when(inside, F.col("__pmf") / F.col("__total")).otherwise(0.0).alias("pmf"), F.when(F.col("x") > left + 1, F.col("__tail") / F.col("__total")).otherwise(1.0).alias("sf"))


def conservative(pairs: DataFrame) -> DataFrame:
    """Parameters that need no fit: r is the slice, w is one, p follows the BAD."""
    bad = F.col("bad")
    return pairs.select("bad", "allele", "slice").distinct().select(
        "bad", "allele", "slice", F.col("slice").cast("double").alias("r"), F.lit(1.0).alias("w"), (bad / (bad + 1)).alias("p1"), (1 / (bad + 1)).alias("p2")
    )


def override(params: DataFrame, stats: DataFrame, gof: float | None, min_n: int) -> DataFrame:
    """Conservative parameters where a slice fits badly (rmsea above ``gof``) or has too few observations."""
    joined = params.join(stats.select("bad", "allele", "slice", "n", "rmsea"), ["bad", "allele", "slice"], "left")
    bad = F.coalesce("n", F.lit(0)) < min_n
    if gof is not None:
        bad = bad | (F.coalesce("rmsea", F.lit(float("inf"))) > gof)
    b = F.col("bad")
    swap = {"r": F.col("slice").cast("double"), "w": F.lit(1.0), "p1": b / (b + 1), "p2": 1 / (b + 1)}
    return joined.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in swap.items()}).drop("n", "rmsea")


def mixture_scores(pairs: DataFrame, params: DataFrame, left: int = 4, correction: str = "single", dist: str = "nb") -> DataFrame:
    """pval and es of each (bad, allele, x, slice) under w * D(p1) + (1 - w) * D(p2).

    ``correction`` moves the weight by the pair's own likelihoods: none, hard or single.
    Every pair is scored: one whose slice has no parameters is an error, so take the
    nearest slice's (``qc.nearest_params``) or ``conservative`` ones where some are missing.
    """
    keys = ["bad", "allele", "slice"]
    wanted = ["r", "w", "p1", "p2", *(["k"] if dist == "betanb" else [])]
    rows = pairs.select(*keys, "x").distinct().join(params.select(*keys, *wanted), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no parameters for "), F.to_json(F.struct(*keys))))
    rows = rows.withColumn("r", F.when(F.col("r").isNull(), missing.cast("double")).otherwise(F.col("r")))
    for side in ("1", "2"):
        rows = with_tails(rows, left, dist, f"p{side}", side)
    rows = rows.withColumn("w", corrected_weight(F.col("w"), F.col("logpmf1"), F.col("logpmf2"), correction))
    both = lambda c: F.when(F.col("w") == 1, F.col(f"{c}1")).when(F.col("w") == 0, F.col(f"{c}2")).otherwise(F.col("w") * F.col(f"{c}1") + (1 - F.col("w")) * F.col(f"{c}2"))
    return rows.select(*keys, "x", "w", both("sf").alias("pval"), (F.log2("x") - F.log2(both("mean"))).alias("es"))


def corrected_weight(w: Column, lp1: Column, lp2: Column, correction: str) -> Column:
    if correction == "none":
        return w
    if correction == "hard":
        new = F.when(lp1 > lp2, 1.0).otherwise(0.0)
    else:
        odds = w / (1 - w) * F.exp(lp1 - lp2)
        new = F.when(odds == float("inf"), 1.0).otherwise(odds / (1 + odds))
    return F.when((w > 0) & (w < 1), new).otherwise(w)


def wide(scores: DataFrame) -> DataFrame:
    """Scores by (bad, ref_count, alt_count), one row with both alleles."""
    ref = scores.where("allele = 'ref'").select("bad", F.col("x").alias("ref_count"), F.col("slice").alias("alt_count"), F.col("pval").alias("ref_pval"), F.col("es").alias("ref_es"))
    alt = scores.where("allele = 'alt'").select("bad", F.col("slice").alias("ref_count"), F.col("x").alias("alt_count"), F.col("pval").alias("alt_pval"), F.col("es").alias("alt_es"))
    return ref.join(alt, ["bad", "ref_count", "alt_count"])


def _log_pmf(y: np.ndarray, n: float, p: float, k: float | None) -> np.ndarray:
    """Of the binomial, or with a concentration k the beta-binomial, up to a constant."""
    choose = -special._np_lgamma(y + 1) - special._np_lgamma(n - y + 1)
    if k is None:
        return choose + y * np.log(p) + (n - y) * np.log1p(-p)
    return choose + special._np_lgamma(y + p * k) + special._np_lgamma(n - y + (1 - p) * k)


def binomial_test(counts: DataFrame, left: int = 4, w: float | None = None, k: float | None = None, p: Column | None = None) -> DataFrame:
    """Left-truncated (beta-)binomial test of both alleles over n = ref + alt.

    Without ``w``, or at BAD 1, one mode: p = 1/2 for the binomial, bad / (bad + 1) for
    the beta-binomial; else the mixture w * D(p) + (1 - w) * D(1 - p). Both counts exceed ``left``.

    The distinct pairs of a (BAD, n) are one row, and its tails are running sums over n
    numbers in the task, so what is shuffled grows with the distinct pairs and not with the support.
    """
    b = F.col("bad")
    p = b / (b + 1) if p is None else p
    single = F.lit(True) if w is None else b == 1
    default = p if k is not None else F.lit(0.5)
    weight = 1.0 if w is None else w
    pairs = counts.select("bad", "ref_count", "alt_count").where((F.col("ref_count") > left) & (F.col("alt_count") > left)).distinct()
    rows = pairs.withColumn("n", (F.col("ref_count") + F.col("alt_count")).cast("double")).groupBy("bad", "n").agg(F.sort_array(F.collect_list("ref_count")).alias("refs"))
    rows = rows.select("bad", "n", "refs", F.when(single, default).otherwise(p).alias("p1"), F.when(single, default).otherwise(1 - p).alias("p2"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, refs = row["n"], np.array(row["refs"], np.int64)
                y, pval, mean = np.arange(left + 1, n - left), 0.0, 0.0
                for share, q in ((weight, row["p1"]), (1 - weight, row["p2"])):
                    if share:
                        mass = np.exp((lp := _log_pmf(y, n, q, k)) - lp.max())
                        tail = np.cumsum(mass[::-1])[::-1] / mass.sum()
                        tail[0] = 1.0
                        pval, mean = pval + share * tail, mean + share * float(mass @ y / mass.sum())
                alts = int(n) - refs
                side = lambda x, pval=pval, mean=mean: (pval[x - left - 1], np.log2(x) - np.log2(mean))
                (ref_p, ref_es), (alt_p, alt_es) = side(refs), side(alts)
                yield pa.RecordBatch.from_pydict({
                    "bad": np.full(len(refs), row["bad"]), "ref_count": pa.array(refs, pa.int32()), "alt_count": pa.array(alts, pa.int32()), "ref_pval": ref_p, "ref_es": ref_es, "alt_pval": alt_p, "alt_es": alt_es,
                })

    return rows.mapInArrow(solve, "bad double, ref_count int, alt_count int, ref_pval double, ref_es double, alt_pval double, alt_es double")
