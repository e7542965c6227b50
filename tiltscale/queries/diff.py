"""Groups, differential tests and analysis of variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit, ingest, lines
from ..operators import diff as op
from ..sources.store import new_dir, settle, upsert, write_tsv
from . import mle
from .common import OBS, Registry, observed

R = Registry()
SNV, KEYS = op.SNV, [*op.SNV, "bad"]
GROUPS = {"control": range(4), "test": range(4, 8), "third": range(8, 12)}
_G = ", grouped AS (SELECT *, CASE WHEN sample < 4 THEN 'control' WHEN sample < 8 THEN 'test' ELSE 'third' END AS \"group\" FROM obs)\n"


def groups(s, names):
    rows = [(g, f"sample_{i}.tsv") for g in names for i in GROUPS[g]]
    return s.createDataFrame(rows, "group string, scorefile string")


def grouped(s, d, names=("control", "test", "third"), max_cover=None):
    return op.with_groups(observed(s, d), op.require_disjoint(groups(s, names)), max_cover)


def two(s, d):
    """Observations of two groups, of SNVs that both have in that BAD."""
    g = grouped(s, d, ("control", "test"))
    both = g.groupBy(*KEYS).agg(F.count_distinct("group").alias("k")).where("k = 2")
    return g.join(both.select(*KEYS), KEYS, "left_semi")


_K = "chrom, start, alt, bad"
_TWO = OBS.rstrip() + _G.rstrip() + f""", two AS (
  SELECT * FROM grouped WHERE "group" <> 'third' AND ({_K}) IN (SELECT ({_K}) FROM grouped WHERE "group" <> 'third' GROUP BY ALL HAVING count(DISTINCT "group") = 2)
)"""
_THREE = OBS.rstrip() + _G.rstrip() + """, enough AS (
  SELECT * FROM grouped WHERE (chrom, start, alt, "group") IN (SELECT (chrom, start, alt, "group") FROM grouped GROUP BY ALL HAVING count(*) >= 2)
), three AS (
  SELECT * FROM enough WHERE (chrom, start, alt) IN (SELECT (chrom, start, alt) FROM enough GROUP BY ALL HAVING count(DISTINCT "group") >= 2)
)"""


_LAST = {_TWO: "two", _THREE: "three"}


def _fit_sql(source: str, keys: str = _K, dist: str = "nb") -> str:
    """Observations, problems, cells and fits as CTEs."""
    return f"{source}, {mle.cells_sql(_LAST[source], keys)}, {mle.fits_sql(dist)}"


def _rounded(df, digits=7):
    """Doubles as the SQL has them."""
    return df.select(*[(F.round(F.col(f.name) + 3e-11, digits) + 0).alias(f.name) if f.dataType.simpleString() == "double" and f.name != "bad" else F.col(f.name) for f in df.schema])


def _pick(doubles: list[str], digits: int = 7) -> str:
    return ", ".join(f"round({c} + 3e-11, {digits}) + 0 AS {c}" for c in doubles)


R.add("b16_group_rows", lambda s, d: grouped(s, d, max_cover=70).select("row_order", "scorefile", "group"), OBS.rstrip() + _G + "SELECT row_order, scorefile, \"group\" FROM grouped WHERE ref_count + alt_count < 70")
R.add(
    "c5_snv_intersection",
    lambda s, d: two(s, d).select(*SNV).distinct(),
    OBS.rstrip() + _G + "SELECT chrom, start, alt FROM grouped WHERE \"group\" = 'control' INTERSECT SELECT chrom, start, alt FROM grouped WHERE \"group\" = 'test'",
)
R.add("s4_snv_union", lambda s, d: op.gate_groups(grouped(s, d), 1).select(*SNV).distinct(), OBS + "SELECT DISTINCT chrom, start, alt FROM obs")
R.add("b15_difftest_filters", lambda s, d: ingest.matches(ingest.matches(two(s, d), "id", "rs"), "chrom", "chr2").select("row_order", "id", "chrom"), OBS.rstrip() + _G + "SELECT row_order, id, chrom FROM grouped WHERE \"group\" <> 'third' AND (chrom, start, alt) IN (SELECT (chrom, start, alt) FROM grouped WHERE \"group\" <> 'third' GROUP BY chrom, start, alt HAVING count(DISTINCT \"group\") = 2) AND starts_with(id, 'rs') AND starts_with(chrom, 'chr2')")
R.add(
    "d6_group_count_tables",
    lambda s, d: op.group_counts(grouped(s, d)),
    OBS.rstrip() + _G + "SELECT bad, ref_count, alt_count, \"group\", count(*) AS n FROM grouped GROUP BY ALL UNION ALL SELECT bad, ref_count, alt_count, '__all__', count(*) FROM grouped GROUP BY ALL",
)
R.add(
    "d15_sample_gate",
    lambda s, d: op.gate_samples(grouped(s, d), 6, 80).select("row_order", "group"),
    OBS.rstrip() + _G + "SELECT row_order, \"group\" FROM grouped WHERE (chrom, start, alt, \"group\") IN (SELECT (chrom, start, alt, \"group\") FROM grouped GROUP BY chrom, start, alt, \"group\" HAVING count(*) >= 6 AND max(ref_count + alt_count) >= 80)",
)
R.add("d16_group_gate", lambda s, d: op.gate_groups(grouped(s, d), 3).select("row_order"), OBS.rstrip() + _G + "SELECT row_order FROM grouped WHERE (chrom, start, alt) IN (SELECT (chrom, start, alt) FROM grouped GROUP BY ALL HAVING count(DISTINCT \"group\") >= 3)")
R.add(
    "d19_count_effect_size",
    lambda s, d: two(s, d).groupBy(*SNV).agg(F.round(F.avg(F.when(F.col("group") == "test", F.log2("alt_count") - F.log2("ref_count"))) - F.avg(F.when(F.col("group") == "control", F.log2("alt_count") - F.log2("ref_count"))) + 3e-11, 6).alias("es")),
    OBS.rstrip() + _G + "SELECT chrom, start, alt, round(avg(log2(alt_count) - log2(ref_count)) FILTER (\"group\" = 'test') - avg(log2(alt_count) - log2(ref_count)) FILTER (\"group\" = 'control') + 3e-11, 6) + 0 AS es FROM grouped WHERE \"group\" <> 'third' GROUP BY ALL HAVING count(DISTINCT \"group\") = 2",
)


def _both(s, d):
    """What tests need of ``two``."""
    return op.shared_snvs(op.placed(grouped(s, d, ("control", "test"))), KEYS)


def _fits(s, d, dist="nb"):
    return op.solve(_both(s, d), KEYS, dist=dist)[0]


_MLE = f'SELECT {_K}, allele, "group", problem.n, {_pick(["p", "nll", "var", "var_sandwich"])} FROM problem JOIN fit USING (id)'
_LRT = f"SELECT {{0}}, allele, groups, n_all, {_pick(['p_all', 'stat', 'pval'])} FROM ratio"
_WALD = f"SELECT {_K}, allele, n_control, n_test, {_pick(['p_control', 'p_test', 'std_control', 'std_test', 'pval'])} FROM tested"
R.add("g1_mle", lambda s, d: _rounded(_fits(s, d)), _fit_sql(_TWO) + _MLE)
R.add("g1_mle_betanb", lambda s, d: _rounded(_fits(s, d, "betanb"), 6), _fit_sql(_TWO, dist="betanb") + _MLE.replace(", 7)", ", 6)"))
R.add("g1_mle_mcnb", lambda s, d: _fits(s, d, "mcnb"))
R.add("g2_likelihood_ratio", lambda s, d: _rounded(op.lrt(_fits(s, d), KEYS)), _fit_sql(_TWO) + "," + mle.lrt_sql(_K) + _LRT.format(_K))
R.add("g2_likelihood_ratio_betanb", lambda s, d: _rounded(op.lrt(_fits(s, d, "betanb"), KEYS), 6), _fit_sql(_TWO, dist="betanb") + "," + mle.lrt_sql(_K) + _LRT.format(_K).replace(", 7)", ", 6)"))
R.add("g2_likelihood_ratio_mcnb", lambda s, d: op.lrt(_fits(s, d, "mcnb"), KEYS))
R.add("g3_wald", lambda s, d: _rounded(op.wald(_fits(s, d), KEYS, "control", "test")), _fit_sql(_TWO) + "," + mle.wald_sql(_K) + _WALD)
R.add("g4_sandwich_wald", lambda s, d: _rounded(op.wald(_fits(s, d), KEYS, "control", "test", var="var_sandwich")), _fit_sql(_TWO) + "," + mle.wald_sql(_K, "var_sandwich") + _WALD)
R.add("g5_logit_wald", lambda s, d: _rounded(op.wald(_fits(s, d), KEYS, "control", "test", logit=True)), _fit_sql(_TWO) + "," + mle.wald_sql(_K, logit=True) + _WALD)
R.add("g6_contrast_wald", lambda s, d: _rounded(op.wald(_fits(s, d), KEYS, "control", "test", contrast=(1.0, -2.0, 0.5))), _fit_sql(_TWO) + "," + mle.wald_sql(_K, contrast=(1.0, -2.0, 0.5)) + _WALD)
R.add("g8_whole_group_test", lambda s, d: _rounded(op.lrt(op.solve(two(s, d), ["bad"])[0], ["bad"]), 5), _fit_sql(_TWO, "bad") + "," + mle.lrt_sql("bad") + _LRT.format("bad").replace(", 7)", ", 5)"))


def _nb_mean_sql(p: str) -> str:
    """Mean of NB(alt_count, p) given more than four, from its first five terms."""
    raw = [f"exp(lgamma({i} + r) - lgamma(r) - lgamma({i + 1}.0) + {i} * ln({p}) + r * ln(1 - {p}))" for i in range(5)]
    return f"((r * {p} / (1 - {p}) - ({' + '.join(f'{i} * {t}' for i, t in enumerate(raw))})) / (1 - ({' + '.join(raw)})))"


R.add(
    "g7_line_adjusted_r",
    lambda s, d: observed(s, d).select("bad", "alt_count").distinct().select("bad", "alt_count", F.round(op.line_adjusted_r(F.col("bad"), F.col("alt_count") * 1.0, F.lit(0.7)), 7).alias("r")),
    OBS + f""", c AS (SELECT DISTINCT bad, alt_count, alt_count::DOUBLE AS r FROM obs), m AS (SELECT *, {_nb_mean_sql('(bad / (bad + 1))')} AS m1, {_nb_mean_sql('(1 / (bad + 1))')} AS m2 FROM c)
    SELECT bad, alt_count, round(CASE WHEN bad <> 1 THEN r * m1 / (0.7::DOUBLE * m1 + 0.3::DOUBLE * m2) ELSE r END, 7) AS r FROM m""",
)


_SIDES = [f"{a}_{f}" for a in ("ref", "alt") for f in op.TESTED]


def _difftest_sql(tested: str, fields: list[str] = op.TESTED) -> str:
    """CTE tests: one row a key, with both alleles' false discovery rates."""
    once = f"wide AS ({mle.wide_sql(tested, _K, fields)}), once AS ({mle.with_fdr('wide', 'ref_pval', 'ref_fdr_pval')}), "
    return once + f"tests AS ({mle.with_fdr('once', 'alt_pval', 'alt_fdr_pval')})"


_PLAIN = [f"{a}_{f}" for a in ("ref", "alt") for f in (*op.TESTED[2:], "fdr_pval")]
_COUNTS = ", ".join(f"{a}_{c}" for a in ("ref", "alt") for c in ("n_control", "n_test"))


#: A line every fifth slice, made up.
_LINES = "SELECT DISTINCT bad, allele, slice::INT AS node, 1.0::DOUBLE + slice % 3 AS b, slice / 10::DOUBLE AS mu, 0.9::DOUBLE AS slice_power, bad * 10 AS mu_k, 0.5::DOUBLE AS b_k, 0.7::DOUBLE AS w FROM side WHERE slice % 5 = 0"


def _line_mode(s, d):
    g = settle(_both(s, d), "observations")
    at = ingest.orient(ingest.count_table(g)).select("bad", "allele", "slice").distinct().where("slice % 5 = 0")
    made = at.select("*", (F.lit(1.0) + F.col("slice") % 3).alias("b"), (F.col("slice") / 10).alias("mu"), F.lit(0.9).alias("slice_power"), (F.col("bad") * 10).alias("mu_k"), F.lit(0.5).alias("b_k"), F.lit(0.7).alias("w"))
    return _rounded(lines.line_params(g, KEYS, made))


R.add(
    "c8_line_mode",
    _line_mode,
    _TWO + f""", side AS (
  SELECT DISTINCT {_K}, "group", 'ref' AS allele, ref_count AS x, alt_count AS slice FROM two UNION SELECT {_K}, "group", 'alt', alt_count, ref_count FROM two
), every AS (
  SELECT * FROM side UNION SELECT * REPLACE ('__all__' AS "group") FROM side
), line AS ({_LINES}), mean AS (
  SELECT {_K}, allele, "group", avg(slice) AS m FROM every GROUP BY ALL
), near AS (
  SELECT mean.*, l.node FROM mean JOIN line l USING (bad, allele) QUALIFY row_number() OVER (PARTITION BY {_K}, allele, "group" ORDER BY l.node = round_even(m, 0) DESC, abs(l.node - m), l.node) = 1
), raw AS (
  SELECT DISTINCT chrom, start, alt, every.bad, every.allele, "group", every.slice, near.node, l.mu + l.b * pow(every.slice, slice_power) AS r, mu_k + b_k * ln(every.slice) AS k, w
  FROM every JOIN near USING ({_K}, allele, "group") JOIN line l ON l.bad = near.bad AND l.allele = near.allele AND l.node = near.node
), modes AS (SELECT *, {_nb_mean_sql('(bad / (bad + 1))')} AS m1, {_nb_mean_sql('(1 / (bad + 1))')} AS m2 FROM raw)
SELECT {_K}, allele, "group", slice, node AS at, round(CASE WHEN bad <> 1 THEN r * m1 / (w * m1 + (1 - w) * m2) ELSE r END + 3e-11, 7) + 0 AS r, round(k + 3e-11, 7) + 0 AS k FROM modes""",
)


def difftest(s, d, **options):
    return op.difftest(grouped(s, d, ("control", "test")), "control", "test", **options)


def _tests(found):
    """The tests alone, without what is derived from them."""
    return _rounded(found.select(*KEYS, *[f"{a}_{f}" for a in ("ref", "alt") for f in ("n_control", "n_test")], *_PLAIN))


R.add("g9_difftest", lambda s, d: _tests(difftest(s, d)), _fit_sql(_TWO) + "," + mle.wald_sql(_K) + "," + _difftest_sql("tested") + f"SELECT {_K}, {_COUNTS}, {_pick(_PLAIN)} FROM tests")
_PAIR = f"""
tested AS (
  SELECT {_K}, allele, c.n AS n_control, t.n AS n_test, c.p AS p_control, t.p AS p_test, sqrt(c.var) AS std_control, sqrt(t.var) AS std_test, ratio.pval
  FROM ratio JOIN (SELECT * FROM problem JOIN fit USING (id) WHERE "group" = 'control') c USING ({_K}, allele) JOIN (SELECT * FROM problem JOIN fit USING (id) WHERE "group" = 'test') t USING ({_K}, allele)
)"""
R.add(
    "g9_difftest_lrt",
    lambda s, d: _tests(difftest(s, d, method="lrt")),
    _fit_sql(_TWO) + "," + mle.lrt_sql(_K) + "," + _PAIR + "," + _difftest_sql("tested") + f"SELECT {_K}, {_COUNTS}, {_pick(_PLAIN)} FROM tests",
)
R.add("g9_difftest_mcnb", lambda s, d: difftest(s, d, method="lrt", dist="mcnb"))


def _params(s, d, beta):
    """Parameters of the project's own fits, as the line of each (BAD, allele) gives them."""
    cells = settle(ingest.orient(ingest.count_table(observed(s, d))).select("bad", "allele", "slice", "x", "n"), "cells")
    return settle(fit.scoring_params(fit.fit_project(cells, fit.line_window(cells), small=7200, beta=beta), cells), "params")


R.add("g3_wald_fitted_r", lambda s, d: op.wald(op.solve(_both(s, d), KEYS, _params(s, d, False))[0], KEYS, "control", "test"))
R.add("g9_difftest_fitted_betanb", lambda s, d: difftest(s, d, params=_params(s, d, True), dist="betanb"))
_DERIVED = """
more AS (
  SELECT *, log2(ref_p_test) - log2(ref_p_control) AS ref_es_p, log2(alt_p_test) - log2(alt_p_control) AS alt_es_p,
    (log2(ref_p_test) - ln(1 - ref_p_test)) - (log2(ref_p_control) - ln(1 - ref_p_control)) AS ref_es_logit,
    (log2(alt_p_test) - ln(1 - alt_p_test)) - (log2(alt_p_control) - ln(1 - alt_p_control)) AS alt_es_logit,
    CASE WHEN ref_p_control > alt_p_control THEN 'ref' ELSE 'alt' END AS pref_allele_control, CASE WHEN ref_p_test > alt_p_test THEN 'ref' ELSE 'alt' END AS pref_allele_test,
    CASE WHEN ref_pval < alt_pval THEN 'ref|alt' ELSE 'alt|ref' END AS scoring_model
  FROM tests JOIN (
    SELECT chrom, start, alt, avg(log2(alt_count) - log2(ref_count)) FILTER ("group" = 'test') - avg(log2(alt_count) - log2(ref_count)) FILTER ("group" = 'control') AS es_count FROM two GROUP BY ALL
  ) USING (chrom, start, alt)
), chosen AS (
  SELECT *, """ + ", ".join(f"CASE WHEN ref_pval < alt_pval THEN ref_{c} ELSE alt_{c} END AS {c}" for c in ("es_p", "es_logit", "pval", "fdr_pval")) + " FROM more)"
_ALL = [*_PLAIN, *[f"{a}_{c}" for a in ("ref", "alt") for c in ("es_p", "es_logit")], "es_p", "es_logit", "pval", "fdr_pval", "es_count"]
_NAMES = "pref_allele_control, pref_allele_test, scoring_model"
_G14 = _fit_sql(_TWO) + "," + mle.wald_sql(_K) + "," + _difftest_sql("tested") + "," + _DERIVED
R.add("g14_difftest_columns", lambda s, d: _rounded(difftest(s, d), 6), _G14 + f"SELECT {_K}, {_COUNTS}, {_NAMES}, {_pick(_ALL, 6)} FROM chosen")


def _exported(s, d, tests):
    """Tests with their SNVs' metadata, written as a table and read back."""
    path = new_dir(s, "export")
    write_tsv(tests.join(ingest.first_metadata(observed(s, d), ["sample", "row_order"]), SNV), path)
    read = s.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    # numbers as they were, whatever a column's values look like
    return read.select(*[F.col(f.name).cast(tests.schema[f.name].dataType if f.name in tests.columns else f.dataType).alias(f.name) for f in read.schema]).withColumn("start", F.col("start").cast("long"))


_META = "meta AS (SELECT chrom, start, alt, arg_min(id, (sample, row_order)) AS id, arg_min(ref, (sample, row_order)) AS ref FROM obs GROUP BY ALL)"
R.add("a13_export_difftest", lambda s, d: _rounded(_exported(s, d, difftest(s, d)), 6), _G14 + f", {_META} SELECT {_K}, id, ref, {_COUNTS}, {_NAMES}, {_pick(_ALL, 6)} FROM chosen JOIN meta USING (chrom, start, alt)")


def _three(s, d, dist="nb", min_samples=2, **options):
    return op.fit_groups(op.gate_groups(op.gate_samples(op.placed(grouped(s, d)), min_samples), 2), KEYS, dist=dist, **options)


def _pairs(s, d, dist="nb"):
    return op.against_all(_three(s, d, dist, against=True), KEYS)


def _effects(s, d, effect, dist="nb"):
    fits = _three(s, d, dist, effect=effect).where(F.col("group") != op.ALL)
    return fits.select(*KEYS, "allele", "group", *op.EFFECTS[effect][0].split())


_PAIRS = f'SELECT {_K}, allele, "group", n, {_pick(["p", "p_all", "pval"])} FROM pair'
R.add("g10_anova", lambda s, d: _rounded(op.lrt(_three(s, d), KEYS)), _fit_sql(_THREE) + "," + mle.lrt_sql(_K) + _LRT.format(_K))


def _stored(s, d):
    """Groups of combines that were stored under their names."""
    path = new_dir(s, "members")
    for name in GROUPS:
        upsert(groups(s, [name]).select("scorefile"), path, name)
    upsert(groups(s, list(GROUPS)).select("scorefile"), path)
    kept = op.gate_groups(op.gate_samples(op.placed(op.with_groups(observed(s, d), op.require_disjoint(op.stored_groups(s, path)))), 2), 2)
    return op.lrt(op.fit_groups(kept, KEYS), KEYS)


R.add("g10_anova_stored_groups", lambda s, d: _rounded(_stored(s, d)), _fit_sql(_THREE) + "," + mle.lrt_sql(_K) + _LRT.format(_K))
R.add("g11_pairwise", lambda s, d: _rounded(_pairs(s, d)), _fit_sql(_THREE) + "," + mle.pairs_sql(_K) + _PAIRS)
R.add("g11_pairwise_betanb", lambda s, d: _rounded(_pairs(s, d, "betanb"), 6), _fit_sql(_THREE, dist="betanb") + "," + mle.pairs_sql(_K, "betanb") + _PAIRS.replace(", 7)", ", 6)"))
R.add("g11_pairwise_mcnb", lambda s, d: _pairs(s, d, "mcnb"))
R.add("g12_entropy_effect", lambda s, d: _rounded(_effects(s, d, "entropy"), 6), _fit_sql(_THREE) + "," + mle.pairs_sql(_K) + "," + mle.effects_sql(_K) + f'SELECT {_K}, allele, "group", {_pick(["es", "es_var"], 6)} FROM effect')
R.add("g12_entropy_effect_betanb", lambda s, d: _effects(s, d, "entropy", "betanb"))
R.add("g13_mean_effect", lambda s, d: _rounded(_effects(s, d, "mean"), 6), _fit_sql(_THREE) + "," + mle.pairs_sql(_K) + "," + mle.effects_sql(_K) + f'SELECT {_K}, allele, "group", {_pick(["mean_es"], 6).replace("AS mean_es", "AS es")} FROM effect')
R.add("g13_mean_effect_betanb", lambda s, d: _effects(s, d, "mean", "betanb"))


def anova(s, d, **options):
    return op.anova(grouped(s, d), list(GROUPS), **options)


_FIELDS = ("p", "pval", "fdr_pval", "es", "es_var")
_G15 = _fit_sql(_THREE) + "," + mle.lrt_sql(_K) + "," + mle.pairs_sql(_K) + "," + mle.effects_sql(_K) + ", paired AS (" + mle.with_fdr(f'(SELECT * FROM pair JOIN (SELECT * EXCLUDE (mean_es) FROM effect) USING ({_K}, allele, "group"))', "pval", "fdr_pval", '"group", allele') + "), "
_G15 += f"pivoted AS (SELECT {_K}, " + ", ".join(f"max({f}) FILTER (\"group\" = '{g}' AND allele = '{a}') AS {g}_{a}_{f}" for g in GROUPS for a in ("ref", "alt") for f in _FIELDS)
_G15 += ", " + ", ".join(f"max(n) FILTER (\"group\" = '{g}') AS {g}_n" for g in GROUPS) + " FROM paired GROUP BY ALL), " + _difftest_sql("ratio", ["pval", "p_all", "n_all"])
_ANOVA = [*[f"{g}_{a}_{f}" for g in GROUPS for a in ("ref", "alt") for f in _FIELDS], *[f"{a}_{f}" for a in ("ref", "alt") for f in ("pval", "p_all", "fdr_pval")]]
_WHOLE = ", ".join([*[f"{g}_n" for g in GROUPS], "ref_n_all", "alt_n_all"])
R.add("g15_anova_pivot", lambda s, d: _rounded(anova(s, d), 6), _G15 + f"SELECT {_K}, {_WHOLE}, {_pick(_ANOVA, 6)} FROM tests JOIN pivoted USING ({_K})")
R.add("a14_export_anova", lambda s, d: _rounded(_exported(s, d, anova(s, d)), 6), _G15 + f", {_META} SELECT {_K}, id, ref, {_WHOLE}, {_pick(_ANOVA, 6)} FROM tests JOIN pivoted USING ({_K}) JOIN meta USING (chrom, start, alt)")
