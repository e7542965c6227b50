"""Sources and sinks, quality tables, slices, reads, and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import combine, export, fit, ingest, lines, qc, score
from ..sources import files, store
from .combine import SCORED, _combined_sql, _scored
from .combine import scores as binom_scores
from .common import OBS, REC, Registry, counted, observed
from .score import _PAIRS, _SCORES, P1, P2, _pmf_table

R = Registry()
KEYS = ["bad", "allele", "slice"]


def oriented(s, d):
    return ingest.orient(counted(s, d)).select(*KEYS, "x", "n")


_O = OBS.rstrip() + ", o AS (SELECT bad, 'ref' AS allele, alt_count AS slice, ref_count AS x, n FROM counts UNION ALL SELECT bad, 'alt', ref_count, alt_count, n FROM counts)\n"


def _tables(s, d):
    """The records written as score files, a folder each; odd samples have another header."""
    path = store.new_dir(s, "scorefiles")
    rows = fx.records(s, d)
    first = [F.col("alt"), F.col("chrom").alias("#Chrom"), F.col("ad0").alias("Ref_Counts"), F.col("start").alias("pos"), F.col("ref").alias("REF"), F.col("ad1").alias("alt_counts"), F.col("qual").alias("QUALITY"), F.col("id").alias("name")]
    second = [F.col("chrom").alias("chr"), F.col("start"), F.col("id"), F.col("qual"), F.col("ad1").alias("ALT_count"), F.col("ad0").alias("ref_count"), F.col("ref"), F.col("alt"), F.col("db"), F.col("bad").alias("BAD")]
    for name, kept, columns in (("even", "sample % 2 = 0", first), ("odd", "sample % 2 = 1", second)):
        store.write_tsv(rows.where(kept).select("scorefile", *columns), f"{path}/{name}", ["scorefile"])
    return [f"{path}/even", f"{path}/odd"]


def _read_tables(s, d):
    out = files.read_table(s, _tables(s, d))
    return out.select("chrom", "start", "ref_count", "alt_count", "ref", "alt", "qual", "id", "db", "bad", F.regexp_extract("scorefile", "scorefile=([^/]+)", 1).alias("scorefile"))


R.add(
    "a1_read_bedlike",
    _read_tables,
    REC + "SELECT chrom, start, ad0 AS ref_count, ad1 AS alt_count, ref, alt, qual, id, sample % 2 = 1 AND db AS db, CASE WHEN sample % 2 = 1 THEN bad ELSE 0 END::DOUBLE AS bad, scorefile FROM records",
)


def _read_map(s, df):
    """A map written in its order, and read back."""
    path = store.new_dir(s, "bad-map")
    names = {"chrom": "#Chr", "start": "Start_pos", "pos": "Start_pos", "end": "End", "bad": "BAD"}
    df.orderBy("map_order").select(*[F.col(c).alias(names[c]) for c in df.columns if c != "map_order"]).write.option("sep", "\t").option("header", True).csv(path)
    return files.read_bad_map(s, path)


R.add(
    "a3_bad_intervals",
    lambda s, d: ingest.range_join_bad(fx.records(s, d), _read_map(s, fx.bad_map(s, d))).select("row_order", "map_bad"),
    REC.rstrip() + f""", m AS ({fx.BAD_MAP}), hit AS (SELECT r.chrom, r.start, arg_max(m.bad, m.map_order) AS map_bad FROM (SELECT DISTINCT chrom, start FROM records) r JOIN m ON r.chrom = m.chrom AND r.start >= m.start AND r.start < m."end" GROUP BY ALL)
    SELECT row_order, map_bad FROM records LEFT JOIN hit USING (chrom, start)""",
)
R.add("a4_bad_positions", lambda s, d: ingest.last_point(_read_map(s, fx.bad_points(s, d))), f"SELECT chrom, pos, arg_max(bad, map_order) AS bad FROM ({fx.BAD_POINTS}) GROUP BY chrom, pos")


def _vcf(s, d):
    info = F.when(F.col("db"), "DB;X=1").otherwise("X=1")
    line = F.concat_ws("\t", "chrom", (F.col("start") + 1).cast("string"), "id", "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"), info, F.lit("GT:DP:AD"), F.concat(F.col("gt"), F.lit(":9:"), F.col("ad0"), F.lit(","), F.col("ad1")))
    path = store.new_dir(s, "vcf")
    rows = fx.records(s, d).select(line.alias("value"), "scorefile")
    rows.unionByName(s.range(1).select(F.lit("##fileformat").alias("value"), F.lit("sample_0.tsv").alias("scorefile"))).write.partitionBy("scorefile").text(path)
    found = files.read_vcf(s.read.text(path))
    return found.select("chrom", "start", "id", "ref", F.concat_ws(",", "alts").alias("alt"), "qual", F.coalesce("db", F.lit(False)).alias("db"), F.concat_ws("/", F.col("gt").cast("array<string>")).alias("gt"), F.get("ad", F.lit(0)).alias("ad0"), F.get("ad", F.lit(1)).alias("ad1"), "scorefile")


R.add("a2_read_vcf", _vcf, REC + "SELECT chrom, start, id, ref, alt, qual, db, gt, ad0, ad1, scorefile FROM records")


def _rejected(s, d):
    base = store.new_dir(s, "mixed")
    good = fx.records(s, d).select("chrom", "start", F.col("ad0").alias("ref_counts"), F.col("ad1").alias("alt_counts"), "ref", "alt")
    for i, df in enumerate((good, good.drop("alt_counts"), good)):
        df.write.option("sep", "\t").option("header", True).csv(f"{base}/{i}")
    sound, bad = files.sort_readable(s, [f"{base}/{i}" for i in range(3)])
    return bad.select(F.substring_index("path", "/", -1).alias("path"), F.lit(len(sound)).alias("sound"))


R.add("a6_rejected_files", _rejected, "SELECT '1' AS path, 2 AS sound FROM (SELECT count(*) FROM lineitem)")


def _written(s, df, by=()):
    path = store.new_dir(s, "export")
    store.write_tsv(df, path, by)
    return s.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)


R.add("a7_export_counts", lambda s, d: _written(s, counted(s, d), ["bad"]).select(F.col("bad").cast("double").alias("bad"), "ref_count", "alt_count", F.col("n").cast("long").alias("n")), OBS + "SELECT bad, ref_count, alt_count, n FROM counts")


def _params_long(s, d):
    p = score.conservative(oriented(s, d))
    return p.select(*KEYS, F.stack(F.lit(4), F.lit("r"), "r", F.lit("w"), "w", F.lit("p1"), "p1", F.lit("p2"), "p2").alias("name", "est")).withColumn("est", F.round("est", 9))


_PARAMS = _PAIRS + f"SELECT bad, allele, slice, unnest(['r', 'w', 'p1', 'p2']) AS name, unnest([r, 1.0::DOUBLE, round({P1}, 9), round(1 / (bad + 1), 9)]) AS est FROM par"
R.add("a8_export_params", lambda s, d: _written(s, _params_long(s, d), ["bad", "allele"]).select(F.col("bad").cast("double").alias("bad"), "allele", "slice", "name", F.col("est").cast("double").alias("est")), _PARAMS)


def _significant(c):
    """Six significant digits, as chi-squared of unlikely cells is huge."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    return F.when(c > 0, F.round(c / unit + 3e-9, 5) * unit).otherwise(c)


_SIX = "CASE WHEN {0} > 0 THEN round({0} / pow(10.0, floor(log10({0}))) + 3e-9, 5) * pow(10.0, floor(log10({0}))) ELSE {0} END"


def _stats(s, d):
    rows = oriented(s, d).select(*KEYS, "x").join(score.conservative(oriented(s, d)).select(*KEYS, "r", F.col("p1").alias("p")), KEYS)
    out = qc.fit_stats(oriented(s, d), score.with_tails(rows).withColumn("pmf", F.exp("logpmf")))
    return out.withColumns({c: _significant(F.col(c)) for c in ("chi2", "rmsea")})


_STATS = (
    _PAIRS + f", s1 AS {_pmf_table(P1)}, o AS (SELECT bad, 'ref' AS allele, alt_count AS slice, ref_count AS x, n FROM counts UNION ALL SELECT bad, 'alt', ref_count, alt_count, n FROM counts), tot AS (SELECT bad, allele, slice, sum(n) AS total FROM o GROUP BY ALL), "
    "m AS (SELECT bad, allele, slice, total, sum(pow(n - pmf * total, 2) / (pmf * total)) + max(total) - sum(pmf * total) AS chi2, count(*) AS cells FROM o JOIN s1 USING (bad, allele, slice, x) JOIN tot USING (bad, allele, slice) GROUP BY bad, allele, slice, total) "
    f"SELECT bad, allele, slice, n, {_SIX.format('chi2')} AS chi2, {_SIX.format('rmsea')} AS rmsea FROM (SELECT bad, allele, slice, CAST(total AS BIGINT) AS n, chi2, sqrt(greatest(chi2 / greatest(cells, 1) - 1, 0) / greatest(total - 1, 1)) AS rmsea FROM m)"
)
R.add("d24_fit_indices", _stats, _STATS)
R.add(
    "d24_log_likelihoods",
    lambda s, d: lines.slice_logliks(oriented(s, d), score.conservative(oriented(s, d)).withColumn("w", F.lit(0.7))).withColumn("loglik", F.round(F.col("loglik") + 3e-11, 6)),
    _PAIRS + _SCORES + """, o AS (SELECT bad, 'ref' AS allele, alt_count AS slice, ref_count AS x, n FROM counts UNION ALL SELECT bad, 'alt', ref_count, alt_count, n FROM counts)
    SELECT bad, allele, slice, CAST(sum(n) AS BIGINT) AS n, round(sum(n * ln(0.7 * s1.pmf + 0.3 * s2.pmf)) + 3e-11, 6) + 0 AS loglik FROM o JOIN s1 USING (bad, allele, slice, x) JOIN s2 USING (bad, allele, slice, x) GROUP BY bad, allele, slice""",
)
R.add("a9_export_fit_indices", lambda s, d: _written(s, _stats(s, d), ["bad", "allele"]).select(F.col("bad").cast("double").alias("bad"), "allele", "slice", F.col("n").cast("long").alias("n"), F.col("chi2").cast("double").alias("chi2"), F.col("rmsea").cast("double").alias("rmsea")), _STATS)
_RAW = ("ref_es", "alt_es", "ref_pval", "alt_pval", "es", "pval")
_BETTER = "CASE WHEN ref_pval < alt_pval THEN ref_{0} ELSE alt_{0} END"
_RAW_SQL = ", ".join(f"round({c if '_' in c else _BETTER.format(c)} + 3e-11, 7) + 0 AS {c}" for c in _RAW)
R.add(
    "a10_export_raw_pvalues",
    lambda s, d: _written(s, export.raw_pvalues(observed(s, d), binom_scores(s, d)), ["scorefile"]).select(
        "scorefile", F.col("#chr").alias("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("bad").cast("double").alias("bad"), "id", "ref", "alt", "ref_count", "alt_count", *[F.round(F.col(c).cast("double") + 3e-11, 7).alias(c) for c in _RAW]
    ),
    SCORED + f"SELECT replace(scorefile, '.tsv', '') AS scorefile, chrom, start, start + 1 AS \"end\", bad, id, ref, alt, ref_count, alt_count, {_RAW_SQL} FROM scored",
)


#: Digits: ln(1 - p) of a p near one has few.
_MULTI = {"mean_bad": 5, "ref_comb_pval": 4, "alt_comb_pval": 4, "ref_comb_es": 5, "alt_comb_es": 5}


def _multi(s, d, members=None):
    """Two projects; scores of every tenth reference count are missing."""
    obs = observed(s, d)
    projects = combine.union_projects([obs.where("orderkey % 2 = 1"), obs.where("orderkey % 2 = 0")])
    if members is not None:
        projects = projects.join(F.broadcast(members), "scorefile", "left_semi")
    least = s.createDataFrame([(0, 25.0), (1, 40.0)], "project int, threshold double")
    out = export.multi_project(projects, binom_scores(s, d).where("ref_count % 10 <> 3"), least, ["project", "sample", "row_order"])
    back = _written(s, out)
    return back.select("chrom", F.col("start").cast("long").alias("start"), "alt", F.col("n_reps").cast("long").alias("n_reps"), "max_cover", *[F.round(F.col(c).cast("double") + 3e-8, n).alias(c) for c, n in _MULTI.items()])


def _multi_sql(kept: str = "true") -> str:
    return (
        SCORED
        + f""", j AS (SELECT obs.*, coalesce(ref_pval, 1) AS ref_pval, coalesce(alt_pval, 1) AS alt_pval, coalesce(ref_es, 0) AS ref_es, coalesce(alt_es, 0) AS alt_es
    FROM obs LEFT JOIN (SELECT * FROM scores WHERE ref_count % 10 <> 3) s USING (bad, ref_count, alt_count)
    WHERE ref_count + alt_count >= CASE WHEN orderkey % 2 = 1 THEN 25 ELSE 40 END AND {kept})"""
        + _combined_sql("j")
        + """, reps AS (SELECT chrom, start, alt, count(*) AS n_reps, max(ref_count + alt_count) AS max_cover, avg(bad) AS mean_bad FROM j GROUP BY ALL)
    SELECT chrom, start, alt, n_reps, max_cover, """
        + ", ".join(f"round({c} + 3e-8, {n}) + 0 AS {c}" for c, n in _MULTI.items())
        + " FROM comb JOIN reps USING (chrom, start, alt)"
    )


R.add("a12_export_multi_project", _multi, _multi_sql())


def _members(s, samples):
    return s.createDataFrame([(f"sample_{i}.tsv",) for i in samples], "scorefile string")


def _multi_stored(s, d):
    """The first project has one stored set, the second a default one besides another."""
    first, second = store.new_dir(s, "members"), store.new_dir(s, "members")
    store.upsert(_members(s, range(6)), first, "only")
    store.upsert(_members(s, range(12)), second, "other")
    store.upsert(_members(s, (1, 10, 11)), second)
    return _multi(s, d, export.stored_members(s, [first, second]))


R.add("a12_stored_subnames", _multi_stored, _multi_sql("CASE WHEN orderkey % 2 = 1 THEN sample <= 5 ELSE sample IN (1, 10, 11) END"))
R.add("d5_scorefile_qc", lambda s, d: qc.scorefile_qc(observed(s, d)).withColumn("bias", F.round(F.col("bias") + 3e-11, 7)), OBS + "SELECT scorefile, bad, CAST(sum(ref_count + alt_count) AS BIGINT) AS cover, round(avg((ref_count > alt_count)::INT) + 3e-11, 7) AS bias FROM obs GROUP BY GROUPING SETS ((scorefile, bad), (scorefile))")


def _qc_export(s, d):
    rows = qc.scorefile_qc(observed(s, d)).withColumn("bias", F.round(F.col("bias") + 3e-11, 7))
    back = _written(s, rows.withColumn("bad", F.coalesce(F.col("bad").cast("string"), F.lit("all"))), ["bad"])
    return back.select("scorefile", "bad", F.col("cover").cast("long").alias("cover"), F.col("bias").cast("double").alias("bias"))


R.add(
    "a15_export_scorefile_qc",
    _qc_export,
    OBS + "SELECT scorefile, coalesce(bad::VARCHAR, 'all') AS bad, CAST(sum(ref_count + alt_count) AS BIGINT) AS cover, round(avg((ref_count > alt_count)::INT) + 3e-11, 7) AS bias FROM obs GROUP BY GROUPING SETS ((scorefile, bad), (scorefile))",
)


def _upserted(s, d):
    path, counts = store.new_dir(s, "stage"), counted(s, d)
    for part, name in ((counts, "first"), (counts.where("bad >= 2"), "second"), (counts.where("bad < 2"), "first")):
        store.upsert(part, path, name)
    return s.read.parquet(path).groupBy("subname", "bad").agg(F.sum("n").alias("n"))


R.add("a16_stage_upsert", _upserted, OBS + "SELECT CASE WHEN bad < 2 THEN 'first' ELSE 'second' END AS subname, bad, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL")


def _foreign(s, d):
    """Scores by the parameters of another project, here that of odd orders and every third slice: the nearest slice's."""
    other = score.conservative(ingest.orient(ingest.count_table(observed(s, d).where("orderkey % 2 = 1")))).where("slice % 3 = 0")
    near = qc.nearest_params(oriented(s, d), other.withColumn("fit_order", F.col("slice")))
    return score.mixture_scores(oriented(s, d), near).withColumns({c: F.round(F.col(c) + 3e-11, 7) for c in ("pval", "es")}).drop("w")


R.add(
    "a18_foreign_params",
    _foreign,
    _PAIRS
    + f""", known AS (SELECT DISTINCT bad, 'ref' AS allele, alt_count AS slice FROM obs WHERE orderkey % 2 = 1 UNION SELECT DISTINCT bad, 'alt', ref_count FROM obs WHERE orderkey % 2 = 1),
    near AS (SELECT p.bad, p.allele, p.slice, arg_min(k.slice, (abs(k.slice - p.slice), k.slice))::DOUBLE AS r FROM par p JOIN known k ON p.bad = k.bad AND p.allele = k.allele WHERE k.slice % 3 = 0 GROUP BY ALL),
    par2 AS (SELECT * FROM near), s1 AS {_pmf_table(P1).replace('FROM par, xs', 'FROM par2, xs')}
    SELECT DISTINCT bad, allele, slice, x, round(sf + 3e-11, 7) + 0 AS pval, round(log2(x) - log2(mean) + 3e-11, 7) + 0 AS es FROM pairs JOIN s1 USING (bad, allele, slice, x)""",
)
R.add("d23_qc_outliers", lambda s, d: qc.outliers(qc.scorefile_qc(observed(s, d)), 1.0).withColumn("bias", F.round(F.col("bias") + 3e-11, 7)), OBS + ", q AS (SELECT scorefile, avg((ref_count > alt_count)::INT) AS bias FROM obs GROUP BY scorefile) SELECT scorefile, round(bias + 3e-11, 7) AS bias FROM q WHERE abs(bias - (SELECT avg(bias) FROM q)) > (SELECT stddev_pop(bias) FROM q)")
R.add("d21_heat_map", lambda s, d: qc.heat_map(counted(s, d), 40).withColumn("value", F.round("value", 7)), OBS + "SELECT *, round(log10(1 + n), 7) AS value FROM counts WHERE ref_count < 40 AND alt_count < 40")


def _density(s, d):
    params = score.conservative(oriented(s, d)).withColumn("w", F.lit(0.7))
    return qc.slice_density(oriented(s, d), params).withColumns({c: F.round(F.col(c) + 3e-11, 7) for c in ("share", "pmf")})


R.add(
    "d22_slice_histogram",
    _density,
    _PAIRS + f", s1 AS {_pmf_table(P1)}, s2 AS {_pmf_table(P2)}" + _O[len(OBS.rstrip()) :].rstrip() + """
    SELECT bad, allele, slice, x, n, round(n / sum(n) OVER (PARTITION BY bad, allele, slice) + 3e-11, 7) AS share, round(0.7 * s1.pmf + (1 - 0.7) * s2.pmf + 3e-11, 7) + 0 AS pmf FROM o JOIN s1 USING (bad, allele, slice, x) JOIN s2 USING (bad, allele, slice, x)""",
)
_PROFILE_COLUMNS = ("mean_ratio", "var_ratio", "mean_es", "var_es")


def _profile_tests(s, d):
    """Tests in the layout of the analysis of variance: here made up of counts, so that SQL has them too."""
    share = F.avg(F.col("ref_count") / (F.col("ref_count") + F.col("alt_count")))
    rows = observed(s, d).groupBy("chrom", "start", "alt", F.col("sample").alias("group")).agg(share.alias("p"), F.count("*").alias("n"))
    return rows.select("chrom", "start", "alt", "group", F.explode(F.array(F.lit("ref"), F.lit("alt"))).alias("allele"), "p", F.lit(0.5).alias("p_all"), (F.lit(0.1) / F.col("n")).alias("pval"), (F.lit(0.15) / F.col("n")).alias("fdr_pval"))


R.add(
    "d20_effect_profile",
    lambda s, d: qc.effect_profile(_scored(s, d).withColumn("group", F.col("sample")), _profile_tests(s, d)).withColumns({c: F.round(F.col(c) + 3e-11, 6) for c in (*_PROFILE_COLUMNS, "log_p")}).drop("place"),
    SCORED
    + """, l AS (SELECT chrom, start, alt, sample AS "group", 'ref' AS allele, log2(ref_count / alt_count) AS ratio, ref_es AS es FROM scored UNION ALL SELECT chrom, start, alt, sample, 'alt', -log2(ref_count / alt_count), alt_es FROM scored),
    tests AS (SELECT chrom, start, alt, sample AS "group", avg(ref_count / (ref_count + alt_count)) AS p, count(*) AS n FROM obs GROUP BY ALL)
    SELECT chrom, start, alt, "group", allele, """
    + ", ".join(f"round({f}(l.{v}) + 3e-11, 6) + 0 AS {n}" for f, v, n in (("avg", "ratio", "mean_ratio"), ("var_pop", "ratio", "var_ratio"), ("avg", "es", "mean_es"), ("var_pop", "es", "var_es")))
    + """, round(log2(any_value(p)) + 1 + 3e-11, 6) + 0 AS log_p, 0.1::DOUBLE / any_value(n) < 0.05 AS low, 0.15::DOUBLE / any_value(n) < 0.05 AS fdr_low FROM l JOIN tests USING (chrom, start, alt, "group") GROUP BY chrom, start, alt, "group", allele""",
)


def _sparse(s, d):
    """Parameters of every fifth slice, with a fit order."""
    p = oriented(s, d).select(*KEYS).distinct().where("slice % 5 = 0")
    return p.select(*KEYS, (F.lit(1.0) + F.col("slice") % 3).alias("b"), (F.col("slice") / 10).alias("mu"), F.lit(0.5).alias("b_k"), (F.col("bad") * 10).alias("mu_k"), F.col("slice").alias("fit_order"))


_NEAR = _O + ", p AS (SELECT DISTINCT bad, allele, slice AS at, 1.0::DOUBLE + slice % 3 AS b, slice / 10 AS mu, 0.5::DOUBLE AS b_k, bad * 10 AS mu_k FROM o WHERE slice % 5 = 0), nr AS (SELECT o.bad, o.allele, o.slice, arg_min(p, (abs(p.at - o.slice), p.at)) AS q FROM (SELECT DISTINCT bad, allele, slice FROM o) o JOIN p ON p.bad = o.bad AND p.allele = o.allele GROUP BY ALL)\n"
R.add("c7_nearest_slice", lambda s, d: qc.nearest_params(oriented(s, d), _sparse(s, d)).select(*KEYS, "at", "b", "mu"), _NEAR + "SELECT bad, allele, slice, q.at AS at, q.b AS b, q.mu AS mu FROM nr")
R.add("c8_evaluate_params", lambda s, d: qc.evaluate_params(qc.nearest_params(oriented(s, d), _sparse(s, d))).select(*KEYS, F.round("r", 7).alias("r"), F.round("k", 7).alias("k")), _NEAR + "SELECT bad, allele, slice, round(q.mu + q.b * slice, 7) AS r, round(q.mu_k + q.b_k * slice, 7) AS k FROM nr")
_PROFILED = ("r", "k", "inv_k", "std_inv_k", "p_sum", "p_share", "expected_p1", "expected_p2")


def _parameter_profile(s, d):
    params = _sparse(s, d).withColumns({"p1": F.lit(0.6), "p2": F.lit(0.3), "std_k": F.lit(0.5)})
    return qc.parameter_profile(params).withColumns({c: F.round(F.col(c) + 3e-11, 7) for c in _PROFILED})


R.add(
    "d25_parameter_profile",
    _parameter_profile,
    _O
    + """, p AS (SELECT DISTINCT bad, allele, slice AS at, 1.0::DOUBLE + slice % 3 AS b, slice / 10 AS mu, 0.5::DOUBLE AS b_k, bad * 10 AS mu_k FROM o WHERE slice % 5 = 0),
    g AS (SELECT bad, allele, unnest(range(0, top + 1))::INT AS slice FROM (SELECT bad, allele, max(p.at) AS top FROM p GROUP BY bad, allele)),
    nr AS (SELECT g.bad, g.allele, g.slice, arg_min(p, (abs(p.at - g.slice), p.at)) AS q FROM g JOIN p ON p.bad = g.bad AND p.allele = g.allele GROUP BY ALL),
    v AS (SELECT bad, allele, slice, q.mu + q.b * slice AS r, q.mu_k + q.b_k * slice AS k FROM nr)
    SELECT bad, allele, slice, """
    + ", ".join(f"round({v} + 3e-11, 7) + 0 AS {n}" for n, v in zip(_PROFILED, ("r", "k", "1 / k", "0.5 / k / k", "0.6::DOUBLE + 0.3", "0.6::DOUBLE / (0.6::DOUBLE + 0.3)", "bad / (bad + 1)", "1 / (bad + 1)"), strict=True))
    + " FROM v",
)


def _profile(s, d):
    st = store.settle(_stats(s, d), "stats")
    return st.where("allele = 'ref'").select("bad", "slice", F.col("rmsea").alias("ref_rmsea")).join(st.where("allele = 'alt'").select("bad", "slice", F.col("rmsea").alias("alt_rmsea")), ["bad", "slice"])


_PROFILE = f"SELECT a.bad, a.slice, a.rmsea AS ref_rmsea, b.rmsea AS alt_rmsea FROM ({_STATS}) a JOIN ({_STATS}) b ON a.bad = b.bad AND a.slice = b.slice AND a.allele = 'ref' AND b.allele = 'alt'"
R.add("d26_fit_profile", _profile, _PROFILE)
R.add("s3_slice_intersection", lambda s, d: oriented(s, d).where("allele = 'ref' AND x > 30").select("bad", "slice").distinct().join(oriented(s, d).where("allele = 'alt' AND x < 9").select("bad", "slice").distinct(), ["bad", "slice"]), _O + "SELECT DISTINCT bad, slice FROM o WHERE allele = 'ref' AND x > 30 INTERSECT SELECT bad, slice FROM o WHERE allele = 'alt' AND x < 9")
R.add("e4_slice_windows", lambda s, d: qc.slice_windows(oriented(s, d), 1500, 3), _O + ", per AS (SELECT bad, allele, slice, sum(n) AS n FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cum, count(*) OVER (PARTITION BY bad, allele) AS m FROM per WINDOW w AS (PARTITION BY bad, allele ORDER BY slice)), t AS (SELECT r.bad, r.allele, r.slice AS centre, k.radius, l.slice AS lo, h.slice AS hi, h.cum - l.cum + l.n AS n, h.i - l.i + 1 AS width, r.m FROM r, unnest(range(0, r.m + 1)) AS k(radius) JOIN r l ON l.bad = r.bad AND l.allele = r.allele AND l.i = greatest(r.i - radius, 1) JOIN r h ON h.bad = r.bad AND h.allele = r.allele AND h.i = least(r.i + radius, r.m)) SELECT bad, allele, centre, arg_min(lo, radius) AS lo, arg_min(hi, radius) AS hi, CAST(arg_min(n, radius) AS BIGINT) AS n FROM t WHERE (n >= 1500 AND width >= 3) OR radius = m GROUP BY bad, allele, centre")
R.add("b19_snv_selection", lambda s, d: ingest.select_snvs(ingest.first_metadata(observed(s, d), ["sample", "row_order"]), fx.table(s, d, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("rs"), "p_partkey").alias("id")), ["id"]), OBS + "SELECT chrom, start, alt, arg_min(id, (sample, row_order)) AS id, arg_min(ref, (sample, row_order)) AS ref FROM obs GROUP BY chrom, start, alt HAVING arg_min(id, (sample, row_order)) IN (SELECT concat('rs', p_partkey) FROM part WHERE p_partkey % 7 = 0)")
R.add("c6_snv_results_join", lambda s, d: observed(s, d).join(combine.combine(combine.in_group(_scored(s, d), ["sample_1.tsv"])), ["chrom", "start", "alt"]).select("row_order", F.round(F.col("ref_comb_es") + 3e-11, 6).alias("es")), SCORED + ", c AS (SELECT chrom, start, alt, avg(ref_es) AS es FROM scored WHERE sample = 1 GROUP BY ALL) SELECT row_order, round(es + 3e-11, 6) + 0 AS es FROM obs JOIN c USING (chrom, start, alt)")
R.add("b17_fixed_params", lambda s, d: fit.with_fixed(_params_long(s, d), s.createDataFrame(fit.parse_fixed("w=0.9;r=3;w=0.5"), "name string, value double, priority int")), f"SELECT bad, allele, slice, name, CASE name WHEN 'w' THEN 0.5 WHEN 'r' THEN 3.0 ELSE est END::DOUBLE AS est FROM ({_PARAMS})")
R.add("f14_small_dataset", lambda s, d: fit.strategy(counted(s, d), 7200), OBS + "SELECT bad, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) < 7200 THEN 'conservative' ELSE 'fit' END AS strategy FROM counts GROUP BY bad")
R.add("f17_model_metadata", lambda s, d: fit.meta(counted(s, d)), OBS + "SELECT DISTINCT bad, unnest(['ref', 'alt']) AS allele, 'NB' AS dist, NULL::DOUBLE AS alpha FROM counts")
R.add("f9_estimate_p", lambda s, d: fit.estimate_binomial(oriented(s, d), "p"))
R.add("f10_estimate_k", lambda s, d: fit.estimate_binomial(oriented(s, d), "k"))
R.add("f11_inverse_kl", lambda s, d: fit.estimate_binomial(oriented(s, d), "p", objective="kl"))


def _windows(s, d):
    return qc.slice_windows(oriented(s, d), 3000, 7)


R.add("f12_fit_windows", lambda s, d: fit.fit_windows(oriented(s, d), _windows(s, d)))
R.add("f18_fit_line", lambda s, d: fit.fit_windows(oriented(s, d), fit.line_window(oriented(s, d))))
R.add("f18_fit_slices", lambda s, d: fit.fit_windows(oriented(s, d), fit.slice_window(oriented(s, d))))
R.add("f13_beta_nb_prior", lambda s, d: fit.fit_windows(oriented(s, d), fit.line_window(oriented(s, d)), beta=True, alpha=1.0))


def _symmetric(s, d):
    counts = ingest.symmetrify(counted(s, d))
    o = ingest.orient(counts).select(*KEYS, "x", "n").where("n > 0")
    return fit.fit_windows(o, fit.line_window(o), transform="NB", beta=True)


R.add("f15_symmetric_fit", _symmetric)
R.add("f16_standard_errors", lambda s, d: fit.fit_windows(oriented(s, d), fit.line_window(oriented(s, d))).where("name IN ('b', 'mu', 'w')").select("bad", "allele", "name", "std"))
R.add("f19_estimate_p", lambda s, d: fit.fit_windows(oriented(s, d), fit.line_window(oriented(s, d)), estimate_p=True))


def _adjusted(s, d):
    """Fits of windows, and the same with lines drawn to those before them."""
    o, windows = oriented(s, d), _windows(s, d)
    fits = store.settle(fit.fit_windows(o, windows), "fits")
    return o, fits, lines.adjust_lines(o, windows, fits)


R.add("f19_adjust_line", lambda s, d: _adjusted(s, d)[2])


def _adjusted_logliks(s, d):
    o, fits, drawn = _adjusted(s, d)
    return lines.adjusted_logliks(o, fits, store.settle(drawn, "drawn"))


R.add("f19_adjusted_loglik", _adjusted_logliks)


def _project(s, d):
    """Fitted windows of large BADs, the strategy's of small ones, at every slice."""
    o = oriented(s, d)
    return fit.scoring_params(store.settle(fit.fit_project(o, _windows(s, d), small=7200), "fits"), o)


R.add("c8_fitted_params", _project)


def _snvs(s, d):
    return observed(s, d).select(F.col("chrom").alias("contig"), "start", "ref", "alt").distinct()


_SNVS = ", snvs AS (SELECT DISTINCT chrom AS contig, start, ref, alt FROM obs)"
_READS = f", reads AS ({fx.READS}), met AS (SELECT s.*, read_name, is_read1, remapped, substr(seq, (s.start - pos + 1)::INT, 1) AS base FROM snvs s JOIN reads r ON r.contig = s.contig AND s.start >= pos AND s.start < pos + length(seq))"
R.add("d17_allele_pile_up", lambda s, d: qc.pile_up(fx.reads(s, d), _snvs(s, d)), OBS.rstrip() + _SNVS + _READS + ", per AS (SELECT contig, start, ref, alt, read_name, coalesce(max(base) FILTER (remapped AND is_read1), max(base) FILTER (remapped AND NOT is_read1)) AS b FROM met GROUP BY ALL) SELECT contig, start, ref, alt, count(*) FILTER (b = ref) AS n_ref, count(*) FILTER (b = alt) AS n_alt, count(*) AS n_original, count(*) FILTER (b IS NULL) AS failed_mapping, count(*) FILTER (b <> ref AND b <> alt) AS failed_genotyping FROM per GROUP BY ALL")
R.add("c10_read_overlap", lambda s, d: qc.pile_up(fx.reads(s, d), _snvs(s, d)).select("contig", "start", "n_original"), OBS.rstrip() + _SNVS + _READS + " SELECT contig, start, count(DISTINCT read_name) AS n_original FROM met GROUP BY contig, start, ref, alt")


#: Individuals are the scorefiles' samples; genotypes follow from the place.
_PEOPLE = "SELECT DISTINCT cast(s_suppkey % 12 as int) AS individual FROM supplier"


def _genotypes(s, d):
    people = fx.table(s, d, "supplier").select((F.col("s_suppkey") % 12).cast("int").alias("individual")).distinct()
    key = F.col("p_partkey")
    base = lambda letters: F.substr(F.lit(letters), (key % 4 + 1).cast("int"), F.lit(1))
    variants = fx.table(s, d, "part").select(F.concat(F.lit("chr"), (key % 22 + 1).cast("string")).alias("contig"), key.alias("start"), base("ACGT").alias("ref"), F.when(key % 50 == 49, "TA").otherwise(base("CGTA")).alias("alt"))
    # at most twelve individuals, as their numbers are taken modulo twelve
    geno = variants.crossJoin(F.broadcast(people)).withColumn("gt", (F.col("start") % 3 - F.col("individual") % 2).cast("int"))
    return geno, people.select("individual", F.col("individual").alias("sample"))


def _sample_counts(s, d):
    sums = {"n_ref": F.sum("ref_count"), "n_alt": F.sum("alt_count"), "n_total": F.sum(F.col("ref_count") + F.col("alt_count") + 2), "failed_mapping": F.sum(F.col("ref_count") % 3), "failed_genotyping": F.count("*"), "failed_bias": F.sum(F.col("alt_count") % 2)}
    return observed(s, d).groupBy("sample", F.col("chrom").alias("contig"), "start", "ref", "alt").agg(*[v.cast("long").alias(c) for c, v in sums.items()])


def _recoded(s, d):
    return qc.recode(*_genotypes(s, d), _sample_counts(s, d))


_COUNTED = {"n_ref": "sum(ref_count)", "n_alt": "sum(alt_count)", "n_total": "sum(ref_count + alt_count + 2)", "failed_mapping": "sum(ref_count % 3)", "failed_genotyping": "count(*)", "failed_bias": "sum(alt_count % 2)"}
_RECODED = (
    OBS
    + f""", people AS ({_PEOPLE}), geno AS (SELECT concat('chr', p_partkey % 22 + 1) AS contig, p_partkey AS start, substr('ACGT', (p_partkey % 4 + 1)::INT, 1) AS ref,
      CASE WHEN p_partkey % 50 = 49 THEN 'TA' ELSE substr('CGTA', (p_partkey % 4 + 1)::INT, 1) END AS alt, individual AS sample, p_partkey % 3 - individual % 2 AS gt FROM part, people),
    c AS (SELECT sample, chrom AS contig, start, ref, alt, {', '.join(f'{v} AS {c}' for c, v in _COUNTED.items())} FROM obs GROUP BY ALL),
    rec AS (SELECT contig, start, ref, alt, g.sample, {', '.join(f'CASE WHEN gt = 1 THEN coalesce({c}, 0) ELSE 0 END::BIGINT AS {c}' for c in _COUNTED)} FROM geno g LEFT JOIN c USING (sample, contig, start, ref, alt))
"""
)
R.add("c9_genotype_counts", _recoded, _RECODED + "SELECT * FROM rec")
_LISTS = {"ard": "n_ref + n_alt", "rd": "n_total", "fm": "failed_mapping", "fg": "failed_genotyping", "fb": "failed_bias", "ad": "concat(n_ref, '|', n_alt)"}
R.add(
    "d18_sample_arrays",
    lambda s, d: qc.sample_arrays(_recoded(s, d)).withColumn("fmr", F.round(F.aggregate(F.split("fmr", ","), F.lit(0.0), lambda a, x: a + x.cast("double")) + 3e-11, 7)),
    _RECODED
    + "SELECT contig, start, ref, alt, CAST(sum(n_ref + n_alt) AS BIGINT) AS total, "
    + ", ".join(f"string_agg({v}, ',' ORDER BY sample) AS {c}" for c, v in _LISTS.items())
    + ", round(sum(CASE WHEN n_total = 0 THEN 0 ELSE failed_mapping / n_total END) + 3e-11, 7) + 0 AS fmr FROM rec GROUP BY contig, start, ref, alt HAVING sum(n_ref + n_alt) > 0",
)
R.add("c9_mismatched_alleles", lambda s, d: qc.mismatched(*_genotypes(s, d), _sample_counts(s, d).withColumn("alt", F.when(F.col("start") % 13 == 0, "N").otherwise(F.col("alt")))), _RECODED + "SELECT g.sample, contig, start, g.ref, g.alt FROM geno g JOIN c USING (sample, contig, start) WHERE gt = 1 AND (g.ref <> c.ref OR g.alt <> CASE WHEN start % 13 = 0 THEN 'N' ELSE c.alt END)")
