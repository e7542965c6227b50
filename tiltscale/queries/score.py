"""Distributions, mixture scores and binomial tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import combine, ingest
from ..operators import score as op
from .common import OBS, Registry, counted

R = Registry()
LEFT = 4
KEYS = ["bad", "allele", "slice"]

#: Conservative parameters of all oriented pairs, and the NB log probability of x in SQL.
_ORIENT = """, pairs AS (SELECT bad, 'ref' AS allele, ref_count AS x, alt_count AS slice FROM {0} UNION ALL SELECT bad, 'alt', alt_count, ref_count FROM {0}),
par AS (SELECT DISTINCT bad, allele, slice, slice::DOUBLE AS r FROM pairs), xs AS (SELECT unnest(range(0, (SELECT max(x) + 1 FROM pairs)))::DOUBLE AS y)
"""
_PAIRS = OBS.rstrip() + _ORIENT.format("counts")
#: Pairs of counts to 955 and slices to 351, made from the observed ones.
_HIGH = OBS.rstrip() + ", high AS (SELECT DISTINCT bad, 19 * ref_count + 5 AS ref_count, 7 * alt_count + 1 AS alt_count FROM counts)" + _ORIENT.format("high")
_NB = "exp(lgamma(y + r) - lgamma(r) - lgamma(y + 1.0) + y * ln({p}) + r * ln(1 - {p}))"


def _pmf_table(p: str) -> str:
    """Truncated NB by (bad, allele, slice, x): pmf, sf (one less the lower sum) and mean, as far as counts go."""
    return f"""(SELECT bad, allele, slice, x, raw / mass AS pmf, (r * {p} / (1 - {p}) - first) / mass AS mean,
    CASE WHEN x = {LEFT + 1} THEN 1 ELSE greatest(0, 1 - sum(raw) OVER (PARTITION BY bad, allele, slice ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / mass) END AS sf FROM (
  SELECT bad, allele, slice, r, y::INT AS x, raw, 1 - sum(CASE WHEN y <= {LEFT} THEN raw ELSE 0 END) OVER w AS mass, sum(CASE WHEN y <= {LEFT} THEN raw * y ELSE 0 END) OVER w AS first
  FROM (SELECT *, {_NB.format(p=p)} AS raw FROM par, xs) WINDOW w AS (PARTITION BY bad, allele, slice)) WHERE x > {LEFT})"""


P1, P2 = "(bad / (bad + 1))", "(1 / (bad + 1))"
_SCORES = f", s1 AS {_pmf_table(P1)}, s2 AS {_pmf_table(P2)}\n"


def _pairs(s, d):
    return ingest.orient(counted(s, d)).select(*KEYS, "x")


def _rounded(df, *cols, digits=8):
    # the nudge keeps exact binary fractions off the boundaries of rounding
    return df.withColumns({c: F.round(F.col(c) + 3e-11, digits) for c in cols})


def _params(s, d):
    return op.conservative(_pairs(s, d))


def _high(s, d):
    """Pairs of large counts, made from the observed ones."""
    c = counted(s, d).select("bad", (19 * F.col("ref_count") + 5).alias("ref_count"), (7 * F.col("alt_count") + 1).alias("alt_count"), "n")
    return ingest.orient(c).select(*KEYS, "x")


def _support(s, d):
    top = _pairs(s, d).agg(F.max("x").alias("top"))
    params = _params(s, d).select(*KEYS, "r", F.col("p1").alias("p")).join(F.broadcast(top))
    return op.truncated(op.support(params, KEYS, "nb", F.col("top")), KEYS, LEFT).select(*KEYS, "x", "pmf", "sf")


R.add(
    "e6_support_table",
    lambda s, d: _rounded(_support(s, d), "pmf", "sf"),
    _PAIRS + f", s1 AS {_pmf_table(P1)} SELECT bad, allele, slice, x, round(pmf + 3e-11, 8) + 0 AS pmf, round(sf + 3e-11, 8) + 0 AS sf FROM s1",
)


def _tails(pairs, p, dist="nb", k=None):
    params = op.conservative(pairs).select(*KEYS, "r", F.col(p).alias("p"), *([F.lit(k).alias("k")] if k else []))
    return op.with_tails(pairs.distinct().join(params, KEYS), LEFT, dist).withColumn("pmf", F.exp("logpmf")).select(*KEYS, "x", "pmf", "sf", "mean")


# of large counts the lower sums have fewer digits
_F1 = "SELECT DISTINCT bad, allele, slice, x, round(pmf + 3e-11, 7) + 0 AS pmf, round(sf + 3e-10, 6) + 0 AS sf, round(mean + 3e-11, 6) + 0 AS mean FROM s2 JOIN pairs USING (bad, allele, slice, x)"
for _name, _of, _sql in (("f1_truncated_nb", _pairs, _PAIRS), ("f1_high_counts", _high, _HIGH)):
    R.add(_name, lambda s, d, of=_of: _rounded(_rounded(_tails(of(s, d), "p2"), "pmf", digits=7), "mean", digits=6).withColumn("sf", F.round(F.col("sf") + 3e-10, 6)), _sql + f", s2 AS {_pmf_table(P2)} {_F1}")
_BNB = "exp(lgamma(y + r) - lgamma(r) - lgamma(y + 1.0) + lgamma(a + b) - lgamma(a) - lgamma(b) + lgamma(a + y) + lgamma(b + r) - lgamma(a + b + r + y))"
R.add(
    "f2_truncated_beta_nb",
    lambda s, d: _rounded(_rounded(_tails(_pairs(s, d), "p1", "betanb", 30.0), "pmf", "sf", digits=7), "mean", digits=6),
    _PAIRS
    + f""", raw AS (SELECT bad, allele, slice, r, a, b, y::INT AS x, {_BNB} AS raw FROM (SELECT *, 30.0::DOUBLE * {P1} AS a, 30.0::DOUBLE * (1 - {P1}) AS b FROM par), xs),
    m AS (SELECT bad, allele, slice, 1 - sum(raw) AS mass, sum(raw * x) AS first FROM raw WHERE x <= {LEFT} GROUP BY ALL),
    t AS (SELECT raw.*, mass, first, coalesce(sum(raw) OVER (PARTITION BY bad, allele, slice ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM raw JOIN m USING (bad, allele, slice) WHERE x > {LEFT})
    SELECT DISTINCT bad, allele, slice, x, round(raw / mass + 3e-11, 7) + 0 AS pmf, round(1 - lower / mass + 3e-11, 7) + 0 AS sf, round((r * a / (b - 1) - first) / mass + 3e-11, 6) + 0 AS mean FROM t JOIN pairs USING (bad, allele, slice, x)""",
)


def _mcnb(s, d):
    rows = _pairs(s, d).distinct().join(_params(s, d).select(*KEYS, "r", F.col("p1").alias("p")), KEYS)
    return op.mcnb(rows, KEYS, LEFT)


R.add(
    "f3_truncated_mcnb",
    lambda s, d: _rounded(_mcnb(s, d), "pmf", "sf", digits=7),
    _PAIRS
    + f""", latent AS (SELECT bad, allele, slice, r, m::DOUBLE AS m, {P1} AS p, exp(lgamma(r + 1) - lgamma(m + 1.0) - lgamma(r - m + 1) + m * ln(1 - {P1}) + (r - m) * ln({P1})) / (1 - pow({P1}, r)) AS w FROM par, unnest(range(1, slice + 1)) AS t(m)),
    raw AS (SELECT bad, allele, slice, y::INT AS x, sum(w * exp(lgamma(y + m) - lgamma(m) - lgamma(y + 1.0) + y * ln(p) + m * ln(1 - p))) AS raw FROM latent, xs GROUP BY ALL),
    mass AS (SELECT bad, allele, slice, 1 - sum(raw) AS mass FROM raw WHERE x <= {LEFT} GROUP BY ALL),
    t AS (SELECT bad, allele, slice, x, raw / mass AS pmf, CASE WHEN x = {LEFT + 1} THEN 1 ELSE 1 - sum(raw) OVER (PARTITION BY bad, allele, slice ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / mass END AS sf FROM raw JOIN mass USING (bad, allele, slice) WHERE x > {LEFT})
    SELECT DISTINCT bad, allele, slice, x, round(pmf + 3e-11, 7) + 0 AS pmf, round(sf + 3e-11, 7) + 0 AS sf FROM t JOIN pairs USING (bad, allele, slice, x)""",
)


def _mix(correction, of=_pairs):
    return lambda s, d: _rounded(op.mixture_scores(of(s, d), op.conservative(of(s, d)).withColumn("w", F.lit(0.7)), LEFT, correction), "w", "pval", "es", digits=7)


_WEIGHT = {"none": "0.7", "hard": "CASE WHEN s1.pmf > s2.pmf THEN 1.0 ELSE 0.0 END", "single": "(0.7 / 0.3 * s1.pmf / s2.pmf) / (1 + 0.7 / 0.3 * s1.pmf / s2.pmf)"}


def _mix_sql(correction: str, pairs: str = _PAIRS) -> str:
    return (
        pairs + _SCORES + f", m AS (SELECT DISTINCT bad, allele, slice, x, ({_WEIGHT[correction]})::DOUBLE AS w, s1.sf AS f1, s2.sf AS f2, s1.mean AS m1, s2.mean AS m2 FROM pairs JOIN s1 USING (bad, allele, slice, x) JOIN s2 USING (bad, allele, slice, x)) "
        "SELECT bad, allele, slice, x, round(w + 3e-11, 7) + 0 AS w, round(w * f1 + (1 - w) * f2 + 3e-11, 7) + 0 AS pval, round(log2(x) - log2(w * m1 + (1 - w) * m2) + 3e-11, 7) + 0 AS es FROM m"
    )


R.add("f4_mixture_scores", _mix("none"), _mix_sql("none"))
R.add("f4_high_counts", _mix("none", _high), _mix_sql("none", _HIGH))
R.add("f5_weight_correction_single", _mix("single"), _mix_sql("single"))
R.add("f5_weight_correction_hard", _mix("hard"), _mix_sql("hard"))


def _slice_stats(s, d):
    return ingest.orient(counted(s, d)).groupBy(*KEYS).agg(F.sum("n").alias("n")).withColumn("rmsea", F.lit(0.01) + F.col("slice") % 5 * 0.02)


R.add(
    "f6_conservative_override",
    lambda s, d: op.override(_params(s, d).withColumn("r", F.col("r") + 3).withColumn("w", F.lit(0.6)), _slice_stats(s, d), 0.06, 60).select(*KEYS, "r", "w", F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2")),
    OBS + f""", st AS (SELECT bad, allele, slice, sum(n) AS n, 0.01::DOUBLE + slice % 5 * 0.02::DOUBLE AS rmsea FROM (SELECT bad, 'ref' AS allele, alt_count AS slice, n FROM counts UNION ALL SELECT bad, 'alt', ref_count, n FROM counts) GROUP BY ALL)
    SELECT bad, allele, slice, CASE WHEN n < 60 OR rmsea > 0.06 THEN slice ELSE slice + 3 END::DOUBLE AS r, CASE WHEN n < 60 OR rmsea > 0.06 THEN 1.0 ELSE 0.6 END::DOUBLE AS w, round({P1}, 9) AS p1, round({P2}, 9) AS p2 FROM st""",
)


def _binomial_sql(log_pmf: str, params: str, w: str) -> str:
    """Both modes on 5 to n - 5 for every pair; ``log_pmf`` uses y, n, p and k."""
    mix = lambda a, b: f"({w} * {a} + (1 - {w}) * {b})"
    side = lambda a: f"round({mix(a + '1.sf', a + '2.sf')} + 3e-11, 7) + 0 AS {a}_pval, round(log2({a}_count) - log2({mix(a + '1.mean', a + '2.mean')}) + 3e-11, 7) + 0 AS {a}_es"
    joins = " ".join(f"JOIN t {a}{m} ON {a}{m}.bad = c.bad AND {a}{m}.n = c.cover AND {a}{m}.mode = {m} AND {a}{m}.y = c.{a}_count" for a in ("ref", "alt") for m in (1, 2))
    return (
        OBS + f""", cells AS (SELECT DISTINCT bad, (ref_count + alt_count)::DOUBLE AS n FROM counts), modes AS (SELECT *, {params} FROM cells, (SELECT unnest([1, 2]) AS mode)),
    raw AS (SELECT bad, n, mode, y, exp({log_pmf}) AS raw FROM (SELECT *, unnest(range({LEFT + 1}, n::INT - {LEFT}))::DOUBLE AS y FROM modes)),
    t AS (SELECT bad, n, mode, y, CASE WHEN y = {LEFT + 1} THEN 1 ELSE sum(raw) OVER (PARTITION BY bad, n, mode ORDER BY y DESC) / sum(raw) OVER (PARTITION BY bad, n, mode) END AS sf, sum(raw * y) OVER (PARTITION BY bad, n, mode) / sum(raw) OVER (PARTITION BY bad, n, mode) AS mean FROM raw),
    c AS (SELECT DISTINCT bad, ref_count, alt_count, ref_count + alt_count AS cover FROM counts)
    SELECT c.bad, ref_count, alt_count, {side('ref')}, {side('alt')} FROM c {joins}"""
    )


_BINOM = "lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + y * ln(p) + (n - y) * ln(1 - p)"
_BETABINOM = "lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + lgamma(y + p * k) + lgamma(n - y + (1 - p) * k) - lgamma(n + k)"
_CASE = "CASE WHEN bad = 1 THEN {single} WHEN mode = 1 THEN {p1} ELSE 1 - {p1} END::DOUBLE AS p"


def _tests(**options):
    return lambda s, d: _rounded(op.binomial_test(counted(s, d), LEFT, **options), "ref_pval", "alt_pval", "ref_es", "alt_es", digits=7)


R.add("f7_binomial_test", _tests(), _binomial_sql(_BINOM, "0.5::DOUBLE AS p", "1.0"))
R.add("f7_binomial_mixture", _tests(w=0.6), _binomial_sql(_BINOM, _CASE.format(single="0.5", p1=P1), "0.6"))
R.add("f8_beta_binomial_test", _tests(k=50.0), _binomial_sql(_BETABINOM, f"{P1} AS p, 50.0::DOUBLE AS k", "1.0"))
R.add("f8_beta_binomial_mixture", _tests(w=0.6, k=50.0), _binomial_sql(_BETABINOM, _CASE.format(single=P1, p1=P1) + ", 50.0::DOUBLE AS k", "0.6"))
R.add(
    "special_lgamma",
    lambda s, d: counted(s, d).select("ref_count").distinct().select("ref_count", F.round(special.lgamma(F.col("ref_count") + 0.5), 9).alias("v")),
    OBS + "SELECT DISTINCT ref_count, round(lgamma(ref_count + 0.5), 9) AS v FROM counts",
)
