"""Combination over replicates, coverage gates, false discovery rates and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine as op
from ..operators import export, fit, ingest, qc, score
from ..sources.store import settle
from .common import OBS, Registry, counted, observed

R = Registry()
SNV = op.SNV
_GROUP = ["sample_0.tsv", "sample_1.tsv", "sample_2.tsv", "sample_3.tsv"]


def scores(s, d):
    """Wide binomial scores of the fixture: exact in both engines."""
    return score.binomial_test(counted(s, d), 4)


def _scored(s, d, placed=False):
    return op.with_scores(observed(s, d, placed), scores(s, d))


_T = """, cells AS (SELECT DISTINCT (ref_count + alt_count)::DOUBLE AS n FROM counts),
raw AS (SELECT n, y, exp(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) - n * ln(2)) AS raw FROM (SELECT n, unnest(range(5, n::INT - 4))::DOUBLE AS y FROM cells)),
t AS (SELECT n, y, CASE WHEN y = 5 THEN 1 ELSE sum(raw) OVER (PARTITION BY n ORDER BY y DESC) / sum(raw) OVER (PARTITION BY n) END AS sf, log2(y) - log2(sum(raw * y) OVER (PARTITION BY n) / sum(raw) OVER (PARTITION BY n)) AS es FROM raw),
scores AS (SELECT bad, ref_count, alt_count, a.sf AS ref_pval, a.es AS ref_es, b.sf AS alt_pval, b.es AS alt_es FROM counts JOIN t a ON a.n = ref_count + alt_count AND a.y = ref_count JOIN t b ON b.n = ref_count + alt_count AND b.y = alt_count),
scored AS (SELECT * FROM obs JOIN scores USING (bad, ref_count, alt_count))
"""
SCORED = OBS.rstrip() + _T
_ROUND = {f"{a}_{c}": 7 for a in ("ref", "alt") for c in ("pval", "es")}


def _round(df, cols, digits=7):
    # the nudge keeps exact binary fractions off the boundaries of rounding
    return df.withColumns({c: F.round(F.col(c) + 3e-11, digits) for c in cols})


R.add(
    "c3_score_lookup",
    lambda s, d: _round(_scored(s, d), _ROUND).select("row_order", "bad", *_ROUND),
    SCORED + "SELECT row_order, bad, " + ", ".join(f"round({c} + 3e-11, 7) + 0 AS {c}" for c in _ROUND) + " FROM scored",
)
R.add("c4_group_membership", lambda s, d: op.in_group(observed(s, d), ["m:sample_1?.tsv", "sample_3.tsv"]).select("row_order", "scorefile"), OBS + "SELECT row_order, scorefile FROM obs WHERE regexp_matches(scorefile, '^(sample_1.\\.tsv|sample_3\\.tsv)$')")
R.add(
    "b14_combine_filters",
    lambda s, d: ingest.matches(ingest.matches(ingest.first_metadata(observed(s, d), ["sample", "row_order"]), "id", "rs.*[05]$"), "chrom", "chr1"),
    OBS + "SELECT * FROM (SELECT chrom, start, alt, arg_min(id, (sample, row_order)) AS id, arg_min(ref, (sample, row_order)) AS ref FROM obs GROUP BY chrom, start, alt) WHERE regexp_matches(id, '^rs.*[05]$') AND starts_with(chrom, 'chr1')",
)
_THR = ", thr AS (SELECT bad, least(coalesce(min(CASE WHEN ref_es > 0.05 AND ref_pval < 0.05 THEN ref_count + alt_count END), 'inf'::DOUBLE), coalesce(min(CASE WHEN alt_es > 0.05 AND alt_pval < 0.05 THEN ref_count + alt_count END), 'inf'::DOUBLE)) AS threshold FROM scores GROUP BY bad)\n"
R.add("d7_coverage_thresholds", lambda s, d: op.coverage_thresholds(scores(s, d)), SCORED + _THR + "SELECT * FROM thr")


def _gated(s, d):
    return op.gate_any(op.in_group(_scored(s, d), _GROUP), op.coverage_thresholds(scores(s, d)))


R.add(
    "d11_gate_any_replicate",
    lambda s, d: _gated(s, d).select("row_order", *SNV),
    SCORED + _THR + ", g AS (SELECT * FROM scored WHERE sample < 4) SELECT row_order, chrom, start, alt FROM g WHERE (chrom, start, alt) IN (SELECT (chrom, start, alt) FROM g JOIN thr USING (bad) WHERE ref_count + alt_count >= threshold)",
)


def _projects(s, d):
    obs = _scored(s, d)
    return op.union_projects([obs.where("orderkey % 2 = 1"), obs.where("orderkey % 2 = 0")])


def _project_thresholds():
    return lambda s, d: s.createDataFrame([(0, 25.0), (1, 40.0)], "project int, threshold double")


R.add(
    "d12_gate_each_replicate",
    lambda s, d: op.gate_each(_projects(s, d), _project_thresholds()(s, d), ["project"]).select("row_order", "project", "scorefile"),
    SCORED + "SELECT row_order, 1 - orderkey % 2 AS project, concat('[', 1 - orderkey % 2, '] ', scorefile) AS scorefile FROM scored WHERE ref_count + alt_count >= CASE WHEN orderkey % 2 = 1 THEN 25 ELSE 40 END".replace("1 - orderkey % 2 AS project", "CAST(1 - orderkey % 2 AS INT) AS project"),
)
R.add("s1_union_projects", lambda s, d: _projects(s, d).groupBy("project", "scorefile").agg(F.count("*").alias("n")), SCORED + "SELECT CAST(1 - orderkey % 2 AS INT) AS project, concat('[', 1 - orderkey % 2, '] ', scorefile) AS scorefile, count(*) AS n FROM scored GROUP BY ALL")


def _group_table(s, d):
    return s.createDataFrame([(0, "^\\[0\\] sample_[0-5]\\."), (1, "^\\[1\\] sample_1")], "project int, pattern string")


R.add(
    "s2_project_groups",
    lambda s, d: _projects(s, d).join(F.broadcast(_group_table(s, d)), "project").where("scorefile rlike pattern").select("row_order", "project", "scorefile"),
    SCORED + "SELECT row_order, CAST(1 - orderkey % 2 AS INT) AS project, concat('[', 1 - orderkey % 2, '] ', scorefile) AS scorefile FROM scored WHERE CASE WHEN orderkey % 2 = 1 THEN sample <= 5 ELSE sample IN (1, 10, 11) END",
)

#: Tail of Student's t by Simpson's rule with 2000 cells, over the distinct (t, df) of ``q``.
_TSF = """, tq AS (SELECT DISTINCT t, df FROM q WHERE k > 1),
grid AS (SELECT t, df, CASE WHEN abs(t) >= 1 THEN 1 / abs(t) ELSE abs(t) END AS top, i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM tq, unnest(range(0, 2001)) AS g(i)),
area AS (SELECT t, df, top / 6000 * sum(c * CASE WHEN abs(t) < 1 THEN pow(1 + pow(top * i / 2000, 2) / df, -(df + 1) / 2) WHEN i = 0 THEN 0 ELSE pow(1 + 1 / (df * pow(top * i / 2000, 2)), -(df + 1) / 2) / pow(top * i / 2000, 2) END)
  * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS a FROM grid GROUP BY t, df, top),
tsf AS (SELECT t, df, CASE WHEN abs(t) >= 1 THEN CASE WHEN t > 0 THEN a ELSE 1 - a END WHEN t >= 0 THEN 0.5 - a ELSE 0.5 + a END AS sf FROM area)
"""


def _combined_sql(source: str, keys: str = "chrom, start, alt", es: str = "avg(es)") -> str:
    return f""", long AS (SELECT *, ref_pval AS p, ref_es AS es, 'ref' AS allele FROM {source} UNION ALL SELECT *, alt_pval, alt_es, 'alt' FROM {source}),
agg AS (SELECT {keys}, allele, count(*) FILTER (p < 1) AS k, sum(-ln(p) + ln(1 - p)) FILTER (p < 1) AS total, max(p) FILTER (p < 1) AS one, {es} AS es FROM long GROUP BY {keys}, allele),
q AS (SELECT *, 5 * k + 4.0::DOUBLE AS df, total * sqrt(3 * (5 * k + 4.0::DOUBLE) / (k * pi() * pi() * (5 * k + 2.0::DOUBLE))) AS t FROM agg)
{_TSF}, c AS (SELECT {keys}, allele, es, CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN one ELSE sf END AS p FROM q LEFT JOIN tsf ON tsf.t = q.t AND tsf.df = q.df),
comb AS (SELECT {keys}, max(p) FILTER (allele = 'ref') AS ref_comb_pval, max(p) FILTER (allele = 'alt') AS alt_comb_pval, max(es) FILTER (allele = 'ref') AS ref_comb_es, max(es) FILTER (allele = 'alt') AS alt_comb_es FROM c GROUP BY {keys})
"""


_COMB = ["ref_comb_pval", "alt_comb_pval", "ref_comb_es", "alt_comb_es"]
_PICK = ", ".join(f"round({c} + 3e-11, 6) + 0 AS {c}" for c in _COMB)
R.add("d8_logit_combination", lambda s, d: _round(op.combine(_gated(s, d)), _COMB, 6), SCORED + _THR + ", gated AS (SELECT * FROM scored WHERE sample < 4 AND (chrom, start, alt) IN (SELECT (chrom, start, alt) FROM scored JOIN thr USING (bad) WHERE sample < 4 AND ref_count + alt_count >= threshold))" + _combined_sql("gated") + f"SELECT chrom, start, alt, {_PICK} FROM comb")
_WES = "coalesce(sum(-log10(p) * es) FILTER (p > 0) / nullif(sum(-log10(p)) FILTER (p > 0), 0), avg(es))"
R.add("d10_weighted_effect_size", lambda s, d: _round(op.combine(_scored(s, d), uniform=False), _COMB, 5), SCORED + _combined_sql("scored", es=_WES) + f"SELECT chrom, start, alt, {_PICK} FROM comb".replace(", 6)", ", 5)"))


def _fisher(s, d):
    from ..functions import special

    agg = _scored(s, d).where("ref_pval < 1").groupBy(*SNV).agg(F.sum(-2 * F.log("ref_pval")).alias("x"), F.count("*").alias("k"))
    return agg.select(*SNV, "k", F.round(special.chi2_sf_even(F.col("x"), F.col("k")) + 3e-11, 7).alias("p"), F.round(special.chi2_sf(F.col("x"), 2 * F.col("k").cast("double")) + 3e-11, 7).alias("p2"))


R.add(
    "d9_fisher_combination",
    _fisher,
    SCORED + ", f AS (SELECT chrom, start, alt, sum(-ln(ref_pval)) AS y, count(*) AS k FROM scored WHERE ref_pval < 1 GROUP BY chrom, start, alt), g AS (SELECT chrom, start, alt, k, round(sum(exp(-y + i * ln(y) - lgamma(i + 1.0))) + 3e-11, 7) + 0 AS p FROM (SELECT *, unnest(range(0, k))::DOUBLE AS i FROM f) GROUP BY ALL) SELECT *, p AS p2 FROM g",
)


def combined(s, d):
    """The main pipeline's combined table with false discovery rates."""
    comb = op.replace_zero(op.combine(_gated(s, d)), ["ref_comb_pval", "alt_comb_pval"], 1.0)
    for a in ("ref", "alt"):
        comb = op.fdr(comb, f"{a}_comb_pval", f"{a}_fdr")
    return comb


_FDR = """, ranked AS (SELECT *, ref_pval * count(*) OVER () / rank_hi AS ratio FROM (SELECT row_order, ref_pval, count(*) OVER (ORDER BY ref_pval RANGE UNBOUNDED PRECEDING) AS rank_hi FROM scored))
SELECT row_order, round(ref_pval + 3e-11, 7) + 0 AS ref_pval, round(least(1, min(ratio) OVER (ORDER BY ref_pval DESC RANGE UNBOUNDED PRECEDING)) + 3e-11, 7) + 0 AS fdr FROM ranked"""
R.add("e1_benjamini_hochberg", lambda s, d: _round(op.fdr(_scored(s, d).select("row_order", "ref_pval"), "ref_pval", "fdr"), ["ref_pval", "fdr"]), SCORED + _FDR)
R.add(
    "e2_fdr_by_group",
    lambda s, d: _round(op.fdr(_scored(s, d).select("row_order", "sample", F.when(F.col("ref_count") != 20, F.col("ref_pval")).alias("p")), "p", "fdr", by=["sample"]), ["p", "fdr"]),
    SCORED + """, u AS (SELECT row_order, sample, ref_pval AS p FROM scored WHERE ref_count <> 20), ranked AS (SELECT *, p * count(*) OVER (PARTITION BY sample) / count(*) OVER (PARTITION BY sample ORDER BY p RANGE UNBOUNDED PRECEDING) AS ratio FROM u)
SELECT row_order, sample, round(p + 3e-11, 7) + 0 AS p, round(least(1, min(ratio) OVER (PARTITION BY sample ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) + 3e-11, 7) + 0 AS fdr FROM ranked UNION ALL SELECT row_order, sample, NULL, NULL FROM scored WHERE ref_count = 20""",
)
R.add(
    "e3_zero_p_replacement",
    lambda s, d: _round(op.replace_zero(_scored(s, d).select("row_order", F.when(F.col("row_order") % 9 == 0, 0.0).otherwise(F.col("ref_pval")).alias("p")), ["p"], 1.0), ["p"], 9),
    SCORED + ", z AS (SELECT row_order, CASE WHEN row_order % 9 = 0 THEN 0 ELSE ref_pval END AS p FROM scored) SELECT row_order, round(CASE WHEN p = 0 THEN (SELECT min(p) FROM z WHERE p > 0) ELSE p END + 3e-11, 9) + 0 AS p FROM z",
)
R.add(
    "e5_preferred_allele",
    lambda s, d: _round(op.preferred(_scored(s, d), ["pval", "es"]).select("row_order", "pref_allele", "pval", "es"), ["pval", "es"]),
    SCORED + "SELECT row_order, CASE WHEN ref_pval < alt_pval THEN 'ref' ELSE 'alt' END AS pref_allele, round(CASE WHEN ref_pval < alt_pval THEN ref_pval ELSE alt_pval END + 3e-11, 7) + 0 AS pval, round(CASE WHEN ref_pval < alt_pval THEN ref_es ELSE alt_es END + 3e-11, 7) + 0 AS es FROM scored",
)
R.add(
    "d14_significance_summary",
    lambda s, d: op.significance(_scored(s, d), 0.05, "ref_pval", "alt_pval"),
    SCORED + "SELECT count(*) FILTER (ref_pval < 0.05) AS ref, count(*) FILTER (alt_pval < 0.05) AS alt, count(*) FILTER (ref_pval < 0.05 AND alt_pval < 0.05) AS both, count(*) FILTER (ref_pval < 0.05 OR alt_pval < 0.05) AS either, count(*) AS tested, round(100.0::DOUBLE * count(*) FILTER (ref_pval < 0.05 OR alt_pval < 0.05) / count(*), 4) AS percent FROM scored",
)
_ROLL = "SELECT chrom, start, alt, round(avg(bad) + 3e-11, 6) + 0 AS mean_bad, max(ref_count + alt_count) AS max_cover, count(*) AS n_reps, " + ", ".join(f"string_agg({v}, ',' ORDER BY sample, row_order, ref_count) AS {v}s" for v in ("scorefile", "bad", "ref_count", "alt_count")) + " FROM obs GROUP BY chrom, start, alt"
R.add("d13_replicate_roll_up", lambda s, d: _round(op.roll_up(observed(s, d), ["sample", "row_order", "ref_count"]), ["mean_bad"], 6), OBS + _ROLL)
R.add(
    "d13_score_lists",
    # rows of one sample and row_order stay in the order of the input
    lambda s, d: op.roll_up(_scored(s, d, True).withColumns({c: F.round(F.col(c) + 3e-11, 3).cast("decimal(9,3)") for c in _ROUND}), ["sample", "row_order", "place"]).select(*SNV, *[f"{c}s" for c in _ROUND]),
    SCORED + "SELECT chrom, start, alt, " + ", ".join(f"string_agg(CAST(round({c} + 3e-11, 3) AS DECIMAL(9,3)), ',' ORDER BY sample, row_order) AS {c}s" for c in _ROUND) + " FROM scored GROUP BY chrom, start, alt",
)


def main_pipeline(s, d):
    """create, fit, test, combine and export, by defaults: one row per tested SNV, with its replicates.

    BADs of fewer than 10,000 observations take the conservative strategy.
    """
    obs = observed(s, d)
    cells = settle(ingest.orient(ingest.count_table(obs)).select("bad", "allele", "slice", "x", "n"), "cells")
    fits = settle(fit.fit_project(cells, qc.slice_windows(cells, 10_000, 3, stop_slice_n=10)), "fits")
    wide = settle(score.wide(score.mixture_scores(cells, fit.scoring_params(fits, cells))), "scores")
    scored = settle(op.gate_any(op.with_scores(obs, wide), op.coverage_thresholds(wide)), "scored")
    comb = op.replace_zero(op.combine(scored), ["ref_comb_pval", "alt_comb_pval"], 1.0)
    for a in ("ref", "alt"):
        comb = op.fdr(comb, f"{a}_comb_pval", f"{a}_fdr_comb_pval")
    return export.combined_pvalues(settle(comb, "combined"), scored, ["sample", "row_order"], replicates=True)


_A11 = ["mean_bad", "ref_comb_es", "alt_comb_es", "ref_comb_pval", "alt_comb_pval", "ref_fdr_comb_pval", "alt_fdr_comb_pval", "comb_es", "comb_pval", "fdr_comb_pval"]
R.add("a11_export_combined", lambda s, d: _round(main_pipeline(s, d), _A11, 6))
