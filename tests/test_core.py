import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tiltscale.functions import moments, special, truncated
from tiltscale.operators import combine, diff, export, fit, ingest, lines, qc, score
from tiltscale.queries import registry
from tiltscale.sources import files, store


def test_special_values(spark):
    row = spark.range(1).select(
        special.t_sf(F.lit(2.0), F.lit(9.0)).alias("a"), special.t_sf(F.lit(20.0), F.lit(104.0)).alias("b"), special.t_sf(F.lit(-2.0), F.lit(9.0)).alias("c"),
        special.chi2_sf(F.lit(3.841458820694124), 1).alias("d"), special.chi2_sf(F.lit(10.0), 4).alias("e"), special.chi2_sf_even(F.lit(10.0), F.lit(2)).alias("f"),
        special.norm_sf(F.lit(1.959963984540054)).alias("g"), special.lgamma(F.lit(7.5)).alias("h"),
    ).first()
    assert row.a == pytest.approx(0.0382764, abs=1e-7) and row.c == pytest.approx(1 - row.a)
    assert row.b == pytest.approx(1.0e-37, rel=0.1)
    assert row.d == pytest.approx(0.05) and row.g == pytest.approx(0.025)
    assert row.e == pytest.approx(math.exp(-5) * 6) and row.f == pytest.approx(row.e)
    assert row.h == pytest.approx(math.lgamma(7.5), abs=1e-12)


def test_fdr_with_ties_nulls_and_groups(spark):
    values = [0.01, 0.02, 0.02, 0.04, 0.5, 1.0, 0.0, None]
    df = spark.createDataFrame([(g, p) for g in ("a", "b") for p in values], "g string, p double")
    got = combine.fdr(df, "p", "q", by=["g"]).where("g = 'a'").collect()
    p = sorted(v for v in values if v is not None)
    want = {v: min(1, min(w * len(p) / (max(i for i, u in enumerate(p) if u == w) + 1) for w in p if w >= v)) for v in p}
    assert {r.p: r.q for r in got if r.p is not None} == pytest.approx(want)
    assert [r.q for r in got if r.p is None] == [None]
    assert combine.fdr(df.limit(0), "p", "q").count() == 0


def test_combination_of_one_none_and_underflow(spark):
    rows = [("one", 0.3), ("none", 1.0), ("many", 1e-200), ("many", 1e-250), ("two", 0.04), ("two", 0.03), ("two", 1.0)]
    df = spark.createDataFrame(rows, "alt string, ref_pval double").withColumns({"alt_pval": F.col("ref_pval"), "ref_es": F.lit(1.0), "alt_es": F.lit(-1.0)})
    got = {r.alt: r.ref_comb_pval for r in combine.combine(df, by=["alt"]).collect()}
    assert got["one"] == 0.3 and got["none"] == 1.0
    assert 0 < got["many"] < 1e-25 and 0.001 < got["two"] < 0.01


def test_truncated_distributions_sum_to_one(spark):
    par = spark.createDataFrame([(1, 8.0, 0.6, 40.0), (2, 3.0, 0.5, 25.0)], "id int, r double, p double, k double")
    xs = par.withColumn("x", F.explode(F.sequence(F.lit(5), F.lit(400))))
    tables = [score.with_tails(xs, 4, dist).withColumn("pmf", F.exp("logpmf")) for dist in ("nb", "betanb")] + [score.mcnb(xs, ["id"], 4)]
    for i, table in enumerate(tables):
        for r in table.groupBy("id").agg(F.sum("pmf").alias("s"), F.max("sf").alias("t"), F.min("sf").alias("u")).collect():
            assert r.s == pytest.approx(1, abs=1e-3 if i == 1 else 1e-9) and r.t == 1.0 and r.u >= 0
    counts = spark.createDataFrame([(1.0, 10, 10), (2.0, 30, 6)], "bad double, ref_count int, alt_count int")
    got = {r.bad: r for r in score.binomial_test(counts).collect()}
    ways = [math.comb(20, i) for i in range(5, 16)]
    assert got[1.0].ref_pval == pytest.approx(sum(ways[5:]) / sum(ways)) and got[1.0].ref_es == pytest.approx(0, abs=1e-12)
    swapped = score.binomial_test(counts.toDF("bad", "alt_count", "ref_count")).collect()
    assert {r.bad: r.ref_pval for r in swapped} == pytest.approx({b: r.alt_pval for b, r in got.items()})


def nb_tail(r, p, x, left):
    """P(X >= x | X > left) and the mean in exact fractions; r whole."""
    p = Fraction(p)
    pmf = lambda i: math.comb(i + r - 1, i) * p**i * (1 - p) ** r
    mass = 1 - sum(pmf(i) for i in range(left + 1))
    return (1 - sum(pmf(i) for i in range(x))) / mass, (r * p / (1 - p) - sum(i * pmf(i) for i in range(left + 1))) / mass


def test_scores_of_large_counts(spark):
    cases = [(5.0, 200, 600), (5.0, 200, 750), (5.0, 200, 994), (1.0, 300, 700), (2.0, 5, 990), (1.0, 990, 5), (3.0, 40, 400), (1.5, 6, 701), (1.0, 60, 900)]
    pairs = spark.createDataFrame([(b, "ref", s, x) for b, s, x in cases], "bad double, allele string, slice int, x int")
    got = {(r.bad, r.slice, r.x): r for r in score.mixture_scores(pairs, score.conservative(pairs)).collect()}
    assert got.keys() == set(cases)  # no pair is lost
    for (b, s, x), r in got.items():
        tail, mean = nb_tail(s, b / (b + 1), x, 4)
        assert r.pval == pytest.approx(float(tail), rel=1e-8) and r.es == pytest.approx(math.log2(x) - math.log2(mean), abs=1e-9), (b, s, x)
    assert got[5.0, 200, 600].pval > 0.999 and 0 < got[1.0, 60, 900].pval < 1e-100
    with pytest.raises(Exception, match="no parameters"):
        score.mixture_scores(pairs, score.conservative(pairs.where("slice < 300"))).collect()
    beta = score.conservative(pairs).withColumn("k", F.lit(1e7))
    close = {(r.bad, r.slice, r.x): r for r in score.mixture_scores(pairs, beta, dist="betanb").collect()}
    for key, r in close.items():  # a large concentration is the negative binomial
        assert r.pval == pytest.approx(got[key].pval, rel=0.05, abs=1e-250) and r.es == pytest.approx(got[key].es, abs=1e-3), key


def test_beta_nb_tail_and_mean(spark):
    r, p, k = 7.0, 0.6, 12.0
    a, b = p * k, (1 - p) * k
    lbeta = lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v)
    pmf = [math.exp(math.lgamma(i + r) - math.lgamma(r) - math.lgamma(i + 1) + lbeta(a + i, b + r) - lbeta(a, b)) for i in range(400_000)]
    mass, rows = math.fsum(pmf[5:]), spark.createDataFrame([(x, r, p, k) for x in (5, 6, 40, 300, 2000)], "x int, r double, p double, k double")
    for row in score.with_tails(rows, 4, "betanb").collect():
        assert row.sf == pytest.approx(math.fsum(pmf[row.x :]) / mass, rel=2e-3) and math.exp(row.logpmf) == pytest.approx(pmf[row.x] / mass)
        assert row.mean == pytest.approx(math.fsum(i * q for i, q in enumerate(pmf) if i > 4) / mass, rel=1e-3)


def test_combination_of_zero_p_values(spark):
    rows = [("two", p) for p in (0.0, 0.5, 0.5)] + [("alone", 0.0), ("alone", 1.0), ("plain", 0.2)]
    df = spark.createDataFrame(rows, "alt string, ref_pval double").withColumns({"alt_pval": F.lit(0.5), "ref_es": F.lit(1.0), "alt_es": F.lit(-1.0)})
    combined = combine.combine(df, by=["alt"])
    assert {r.alt: r.ref_comb_pval for r in combined.collect()} == {"two": 0.0, "alone": 0.0, "plain": 0.2}
    replaced = combine.replace_zero(combined, ["ref_comb_pval"], 1.0)
    assert {r.alt: r.ref_comb_pval for r in replaced.collect()} == {"two": 0.2, "alone": 0.2, "plain": 0.2}
    empty = combine.combine(df.limit(0), by=["alt"])
    assert empty.count() == 0 and combine.replace_zero(empty, ["ref_comb_pval"]).count() == 0


def test_significance_of_an_empty_table(spark):
    df = spark.createDataFrame([(0.01, 0.2), (0.5, None)], "ref_fdr double, alt_fdr double")
    assert tuple(combine.significance(df).first()) == (1, 0, 0, 1, 2, 50.0)
    assert tuple(combine.significance(df.limit(0)).first()) == (0, 0, 0, 0, 0, None)


def test_wald_with_undefined_and_zero_variances(spark):
    nan = float("nan")
    cases = {"a": (0.01, 0.01), "null": (None, 0.01), "both": (None, None), "nan": (nan, 0.01), "zero": (0.0, 0.0), "one": (0.0, 0.01), "wide": (float("inf"), 0.01)}
    rows = [(k, "ref", g, 9, p, v) for k, (u, w) in cases.items() for g, p, v in (("c", 0.6, u), ("t", 0.4, w))]
    fits = spark.createDataFrame(rows, "k string, allele string, group string, n long, p double, var double")
    got = {r.k: r.pval for r in diff.wald(fits, ["k"], "c", "t").collect()}
    two = lambda z: math.erfc(z / math.sqrt(2))
    assert {k for k, p in got.items() if p == 1.0} == {"null", "both", "nan", "zero"}
    assert got["a"] == pytest.approx(two(0.2 / math.sqrt(0.02))) and got["one"] == pytest.approx(two(2.0)) and got["wide"] == pytest.approx(two(0.2 / math.sqrt(0.17)))
    logit = {r.k: r.pval for r in diff.wald(fits, ["k"], "c", "t", logit=True).collect()}
    assert logit["null"] == logit["both"] == logit["zero"] == 1.0 and logit["a"] == pytest.approx(two(2 * math.log(1.5) / math.sqrt(0.02 * (1 / 0.24) ** 2)))
    assert diff.wald(fits.limit(0), ["k"], "c", "t").count() == 0
    near_one = {r.k: r.pval for r in diff.wald(fits.withColumn("p", F.lit(1 - 1e-12)), ["k"], "c", "t", contrast=(0.0, 0.0, 0.0)).collect()}
    assert set(near_one.values()) == {1.0}


def likelihood(dist, x, r, k, left=4):
    """One group for each x."""
    return truncated.Likelihood(dist, np.asarray(x, float), np.arange(len(x)), np.asarray(r, float), np.asarray(k, float), left)


def test_entropy_moments_have_no_cap():
    r = np.array([5.0, 60.0])
    for p in (0.5, 0.9, 0.99, 0.999, 0.9999):
        found = moments.log2_moments(likelihood("nb", [5, 5], r, [0, 0]), np.full(2, p))
        gamma = np.random.default_rng(0).gamma(r[:, None], size=(2, 200_000)) * p / (1 - p)
        x = np.log2(np.maximum(np.random.default_rng(1).poisson(gamma), 1))
        keep = np.random.default_rng(1).poisson(gamma) > 4
        for i in range(2):
            assert found.first[i] == pytest.approx(x[i][keep[i]].mean(), abs=0.02) and found.variance[i] == pytest.approx(x[i][keep[i]].var(), abs=0.03)


@pytest.mark.parametrize(("dist", "r", "k", "p", "top"), [("nb", 8, 0, 0.6, 3000), ("nb", 500, 0, 0.99, 300_000), ("betanb", 8, 40, 0.6, 1_000_000), ("betanb", 300, 6000, 0.9, 200_000), ("betanb", 10, 12, 0.5, 1_000_000), ("mcnb", 12, 0, 0.7, 2000)])
def test_moments_are_the_sums_over_the_support(dist, r, k, p, top):
    x = np.arange(5, top)
    if dist == "mcnb":
        steps = truncated.mcnb_steps(np.array([float(r)]), np.array([p]))
        w = np.array([float(np.exp(next(steps).value[0])) for _ in range(top)])[5:]
    else:
        w = np.exp(moments._log_pmf(dist, x.astype(float), *(np.full((1, 1), float(v)) for v in (r, k, p))))[0]
    found = moments.log2_moments(likelihood(dist, [5], [r], [k]), np.array([p]))
    first = w @ np.log2(x) / w.sum()
    assert found.first[0] == pytest.approx(first, abs=1e-9) and found.mean[0] == pytest.approx(w @ x / w.sum(), rel=1e-6)
    assert found.variance[0] == pytest.approx(w @ np.log2(x) ** 2 / w.sum() - first**2, abs=1e-8)


@pytest.mark.parametrize("dist", truncated.DISTS)
def test_truncated_terms_and_their_derivatives(dist):
    rng = np.random.default_rng(3)
    x, r, k, p = rng.integers(5, 60, 200), rng.integers(1, 40, 200), rng.uniform(5, 6000, 200), rng.uniform(0.02, 0.98, 200)
    cells = likelihood(dist, x, r, k)
    t, up, down = (cells.terms(p + h) for h in (0, 1e-6, -1e-6))
    assert (up.value - down.value) / 2e-6 == pytest.approx(t.slope, rel=1e-5, abs=1e-3) and (up.slope - down.slope) / 2e-6 == pytest.approx(t.bend, rel=1e-5, abs=1e-1)
    # probabilities above the truncation sum to one
    every = np.arange(5, 4000)
    one = truncated.Likelihood(dist, every.astype(float), np.zeros(len(every), int), np.array([9.0]), np.array([900.0]), 4).terms(np.array([0.6]))
    free = special._np_lgamma(every + 9.0) - special._np_lgamma(np.array(9.0)) - special._np_lgamma(every + 1.0) if dist != "mcnb" else 0
    free = free + (0 if dist != "betanb" else special._np_lgamma(np.array(900.0)) - special._np_lgamma(900.0 + every + 9) - 0)
    assert np.exp(one.value + free).sum() == pytest.approx(1, abs=1e-8)


def test_compound_recurrence_is_the_sum_over_the_latent_count(spark):
    rows = [(i, x, float(r), p) for i, (r, p) in enumerate([(1, 0.5), (7, 0.3), (25, 0.8), (60, 0.55)]) for x in (5, 6, 19, 80)]
    scored = {(g.id, g.x): g.pmf for g in score.mcnb(spark.createDataFrame(rows, "id int, x int, r double, p double"), ["id"], 4).collect()}
    cells = likelihood("mcnb", [q[1] for q in rows], [q[2] for q in rows], np.zeros(len(rows)))
    found = np.exp(cells.terms(np.array([q[3] for q in rows])).value)
    assert found == pytest.approx([scored[q[0], q[1]] for q in rows], rel=1e-10)


def test_beta_nb_tends_to_nb():
    rng = np.random.default_rng(5)
    x, r = rng.integers(5, 60, 50), rng.integers(5, 40, 50).astype(float)
    plain = cells_of([[(int(a), float(b), 1) for a, b in zip(x, r, strict=True)]]).mle()
    kind = pa.list_(pa.struct([("x", pa.int32()), ("r", pa.float64()), ("k", pa.float64()), ("n", pa.int64())]))
    off = []
    for k in (1e3, 1e5, 1e7):
        rows = sorted((int(a), float(b), k, 1) for a, b in zip(x, r, strict=True))
        beta = diff.Cells(pa.array([[dict(zip(("x", "r", "k", "n"), c, strict=True)) for c in rows]], kind), "betanb").mle()
        off.append(abs(beta[0][0] - plain[0][0]) + abs(beta[2][0] / plain[2][0] - 1))
    assert off[0] > off[1] > off[2] and off[2] < 1e-4


@pytest.mark.parametrize("dist", ["betanb", "mcnb"])
def test_other_distributions_recover_p(spark, dist):
    rng = np.random.default_rng(7)
    r = rng.integers(5, 30, 5000)
    if dist == "betanb":
        theta = rng.beta(0.6 * 50, 0.4 * 50, 5000)
        x = rng.negative_binomial(r, 1 - theta)
    else:
        m = rng.binomial(r, 0.4)
        r, m = r[m > 0], m[m > 0]
        x = rng.negative_binomial(m, 0.4)
    rows = [("c", 1, "A", 2.0, "g" if i % 2 else "h", int(a), int(b)) for i, (a, b) in enumerate(zip(x, r, strict=True)) if a > 4]
    obs = spark.createDataFrame(rows, "chrom string, start int, alt string, bad double, group string, ref_count int, alt_count int")
    slices = [(2.0, a, s, float(s), 50.0) for a in ("ref", "alt") for s in range(400)]
    params = spark.createDataFrame(slices, "bad double, allele string, slice int, r double, k double")
    fits = {f.group: f for f in diff.solve(obs, [*diff.SNV, "bad"], params, dist)[0].where("allele = 'ref'").collect()}
    for f in fits.values():
        assert abs(f.p - 0.6) < 4 * math.sqrt(f.var) and 0.5 < f.var / f.var_sandwich < 2
    ratio = {t.allele: t for t in diff.lrt(diff.solve(obs, [*diff.SNV, "bad"], params, dist)[0], [*diff.SNV, "bad"]).collect()}
    assert ratio["ref"].pval > 1e-4 and ratio["ref"].stat >= 0


def test_drivers_of_difference_tests(spark):
    rng = np.random.default_rng(11)
    rows = [("c", s, "A", 2.0, f"{g}{i}", int(rng.negative_binomial(20, 0.35 if g == "test" and s == 1 else 0.5)) + 5, 20, i) for s in (1, 2) for g in ("control", "test") for i in range(25)]
    rows.append(("c", 3, "A", 2.0, "control0", 9, 12, 0))  # in one group only
    obs = spark.createDataFrame(rows, "chrom string, start long, alt string, bad double, scorefile string, ref_count int, alt_count int, sample int")
    table = spark.createDataFrame([(g, f"{g}{i}") for g in ("control", "test") for i in range(25)], "group string, scorefile string")
    grouped = diff.with_groups(obs, diff.require_disjoint(table))
    for dist in truncated.DISTS:
        for method in ("wald", "lrt"):
            got = {t.start: t for t in diff.difftest(grouped, "control", "test", dist=dist, method=method).collect()}
            assert set(got) == {1, 2} and got[1].ref_fdr_pval < 0.01 < got[2].ref_fdr_pval and got[1].ref_es_p > 0.1
            by = [math.log2(q[6] / q[5]) * (1 if q[4].startswith("test") else -1) / 25 for q in rows if q[1] == 1]
            assert got[1].es_count == pytest.approx(sum(by))
        for effect in ("entropy", "mean"):
            wide = {t.start: t for t in diff.anova(grouped, ["control", "test"], 4, 2, dist=dist, effect=effect).collect()}
            assert set(wide) == {1, 2} and wide[1].ref_fdr_pval < 0.01 and wide[1].test_ref_es > wide[1].control_ref_es and wide[1].test_n == 25
    assert diff.difftest(grouped.limit(0), "control", "test").count() == 0


def test_weight_correction(spark):
    row = spark.range(1).select(*[score.corrected_weight(F.lit(w), F.lit(a), F.lit(b), c).alias(n) for n, w, a, b, c in (("x", 0.5, -1.0, -2.0, "single"), ("y", 0.5, -1.0, -2.0, "hard"), ("z", 1.0, -9.0, -1.0, "single"), ("u", 0.5, 0.0, -5000.0, "single"))]).first()
    assert row.x == pytest.approx(math.e / (1 + math.e)) and (row.y, row.z, row.u) == (1.0, 1.0, 1.0)


def test_range_join_edges(spark):
    snv = spark.createDataFrame([("c", p) for p in (9, 10, 63, 64, 127, 128, 200)] + [("d", 10)], "chrom string, start long")
    bad = spark.createDataFrame([("c", 10, 128, 2.0, 1), ("c", 60, 64, 3.0, 2), ("c", 200, 200, 9.0, 3)], "chrom string, start long, end long, bad double, map_order int")
    got = {(r.chrom, r.start): r.map_bad for r in ingest.range_join_bad(snv, bad).collect()}
    assert got == {("c", 9): None, ("c", 10): 2.0, ("c", 63): 3.0, ("c", 64): 2.0, ("c", 127): 2.0, ("c", 128): None, ("c", 200): None, ("d", 10): None}


def test_resolve_bad_and_consistency(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 2.0, None), (3, 2.0, 3.0)], "id int, bad double, map_bad double")
    assert {r.id: r.bad for r in ingest.resolve_bad(df, 1.0).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}
    assert {r.id: r.bad for r in ingest.resolve_bad(df, None).collect()} == {3: 3.0}
    obs = spark.createDataFrame([("c", 1, "A", 1.0), ("c", 1, "A", 2.0)], "chrom string, start int, alt string, bad double")
    with pytest.raises(ValueError):
        ingest.require_consistent(obs)


def test_headers_and_masks():
    assert files.header_map(["#CHROM", "Start", "REF_counts", "alt_count", "ref", "ALT"])["chrom"] == "#CHROM"
    assert files.header_map(["chrom", "start", "ref", "alt"]) is None
    assert combine.mask_regex("a*[!b]?.tsv") == "a.*[^b].\\.tsv"


def cells_of(problems):
    kind = pa.list_(pa.struct([("x", pa.int32()), ("r", pa.float64()), ("n", pa.int64())]))
    return diff.Cells(pa.array([[{"x": x, "r": r, "n": n} for x, r, n in p] for p in problems], kind))


def test_mle_recovers_p():
    rng = np.random.default_rng(1)
    r = rng.integers(5, 40, 4000).astype(float)
    x = rng.negative_binomial(r, 1 - 0.6)
    many = [(int(a), float(b), 1) for a, b in zip(x, r, strict=True) if a > 4]
    cells = cells_of([many, [(9, 7.0, 3)], many[:50]])
    p, value, var, sandwich = cells.mle()
    assert abs(p[0] - 0.6) < 4 * math.sqrt(var[0]) and abs(var[0] / sandwich[0] - 1) < 0.3
    for i, one in enumerate(([*many], [(9, 7.0, 3)], many[:50])):  # each problem as if it were alone
        alone = cells_of([one])
        assert [a[i] for a in (p, value, var, sandwich)] == pytest.approx([float(a[0]) for a in alone.mle()], nan_ok=True)
        least = min(float(alone.nll(np.array([q]))[0]) for q in np.linspace(max(p[i] - 0.02, 1e-3), p[i] + 0.02, 401))
        assert value[i] <= least + 1e-6


def test_problems_with_fitted_r(spark):
    obs = spark.createDataFrame([("c", 1, "A", 2.0, "g", 9, 12), ("c", 1, "A", 2.0, "h", 20, 12)], "chrom string, start int, alt string, bad double, group string, ref_count int, alt_count int")
    params = spark.createDataFrame([(2.0, a, s, s * 0.5 + 1) for a in ("ref", "alt") for s in (9, 12, 20)], "bad double, allele string, slice int, r double")
    got = {(r.allele, r.group): [tuple(c) for c in r.cells] for r in diff.problems(obs, [*diff.SNV, "bad"], params).collect()}
    assert got["ref", "g"] == [(9, 7.0, 1)] and got["alt", diff.ALL] == [(12, 5.5, 1), (12, 11.0, 1)]
    with pytest.raises(Exception, match="no parameters"):
        diff.problems(obs, ["bad"], params.where("slice < 15")).collect()


def test_binomial_estimate_recovers_p(spark):
    rng = np.random.default_rng(2)
    total = rng.integers(20, 60, 6000)
    x = rng.binomial(total, 0.62)
    rows = [(2.0, "ref", int(a), int(t - a), 1) for a, t in zip(x, total, strict=True) if a > 4 and t - a > 4]
    cells = spark.createDataFrame(rows, "bad double, allele string, x int, slice int, n int")
    assert fit.estimate_binomial(cells, "p").first().est == pytest.approx(0.62, abs=0.01)
    assert fit.estimate_binomial(cells, "p", objective="kl").first().est == pytest.approx(0.62, abs=0.03)


def drawn(seed, n, b, mu, w, bad, k=None):
    """Cells of a mixture of truncated distributions with r = mu + b * slice."""
    rng = np.random.default_rng(seed)
    s = rng.integers(5, 40, n)
    p = np.where(rng.random(n) < w, bad / (bad + 1), 1 / (bad + 1))
    x = np.zeros(n, np.int64)
    while (low := x <= 4).any():  # each mode is truncated by itself
        q = rng.beta(p[low] * k, (1 - p[low]) * k) if k else p[low]
        x[low] = rng.negative_binomial(mu + b * s[low], 1 - q)
    pairs, count = np.unique(np.column_stack([x, s]), axis=0, return_counts=True)
    return fit.WindowCells(pairs[:, 0].astype(float), pairs[:, 1].astype(float), count.astype(float), 4)


def test_fits_recover_parameters():
    cells = drawn(3, 20_000, 0.8, 2.0, 1.0, 1.0)
    est, std, _ = fit.fit_cells(cells, 1.0)
    assert abs(est["b"] - 0.8) < 4 * std["b"] < 0.2 and abs(est["mu"] - 2) < 4 * std["mu"] and est["w"] == 1.0 and std["w"] == 0.0
    assert std["mu"] > 1.5 / math.sqrt(fit._derivatives(lambda v: cells.nll(est | {"mu": float(v[0])}), np.array([est["mu"]]), np.array([1e-3]))[2][0, 0])  # the correlation counts
    for w in (0.25, 0.7):
        est, std, nll = fit.fit_cells(drawn(4, 30_000, 1.1, 1.0, w, 3.0), 3.0)
        assert abs(est["w"] - w) < 4 * std["w"] < 0.1 and abs(est["b"] - 1.1) < 4 * std["b"] and abs(est["mu"] - 1) < 4 * std["mu"]
    est, _, _ = fit.fit_cells(drawn(5, 30_000, 1.0, 0.0, 0.6, 2.0), 2.0, estimate_p=True)
    assert est["p1"] == pytest.approx(2 / 3, abs=0.04) and est["p2"] == pytest.approx(1 / 3, abs=0.04)
    fixed, std, _ = fit.fit_cells(drawn(5, 5000, 1.0, 0.0, 0.6, 2.0), 2.0, fixed={"b": 1.0, "mu": 0.0})
    assert (fixed["b"], fixed["mu"], std["b"]) == (1.0, 0.0, 0.0) and fixed["w"] == pytest.approx(0.6, abs=0.05)


def test_beta_fits_and_their_prior():
    cells = drawn(6, 30_000, 1.0, 1.0, 1.0, 1.0, k=25.0)
    est, _, nll = fit.fit_cells(cells, 1.0, beta=True)
    at = lambda t: t["mu_k"] + t["b_k"] * 20
    assert at(est) == pytest.approx(25, rel=0.25) and nll < fit.fit_cells(cells, 1.0)[2] - 50
    for prior in ("laplace", "normal"):
        assert at(fit.fit_cells(cells, 1.0, beta=True, alpha=1.0, prior=prior)[0]) > at(est) * 1.05  # it asks for a large k
    mean = lambda p, r, k: r * p * k / ((1 - p) * k - 1)
    r, k = np.array([7.0]), np.array([30.0])
    assert mean(0.6, fit.transformed_r(r, 0.6, k, "NB"), k) == pytest.approx(7 * 1.5) and mean(0.6, fit.transformed_r(r, 0.6, k, "mean"), k) == pytest.approx(7)
    assert fit.transformed_r(r, 0.6, None, "NB") == pytest.approx(7) and fit.transformed_r(r, 0.6, None, "mean") * 1.5 == pytest.approx(7)


def test_windows_are_fitted_and_scored(spark):
    rows = [(b, "ref", int(s), int(x), int(n)) for b, seed, size in ((1.0, 3, 9000), (2.0, 4, 400)) for x, s, n in zip(*(lambda c: (c.x, c.s, c.n))(drawn(seed, size, 0.8, 2.0, 0.7, b)), strict=True)]
    cells = spark.createDataFrame(rows, "bad double, allele string, slice int, x int, n int")
    fits = fit.fit_project(cells, fit.line_window(cells), small=1000).cache()
    got = {(r.bad, r.name): r.est for r in fits.collect()}
    assert (got[2.0, "b"], got[2.0, "mu"], got[2.0, "w"]) == (1.0, 0.0, 1.0)  # too small to fit
    assert got[1.0, "b"] == pytest.approx(0.8, abs=0.1)
    params = fit.scoring_params(fits, cells)
    assert params.count() == cells.select("bad", "allele", "slice").distinct().count()
    for r in params.collect():
        assert r.r == pytest.approx(r.slice if r.bad == 2.0 else max(got[1.0, "mu"] + got[1.0, "b"] * r.slice, fit.LEAST)) and r.w == 1.0
    assert score.mixture_scores(cells, params).where("pval BETWEEN 0 AND 1").count() == cells.select("bad", "allele", "slice", "x").distinct().count()
    bare = {r.slice: (r.r, r.w, r.p1) for r in fit.scoring_params(fits.where("bad = 1"), cells.where("bad = 2")).collect()}
    assert len(bare) == cells.where("bad = 2").select("slice").distinct().count() and all(v == (s, 1.0, 2 / 3) for s, v in bare.items())  # no window at all
    single = fit.fit_windows(cells.where("bad = 1"), fit.slice_window(cells.where("bad = 1")), fixed={"b": 1.0}).where("name = 'mu'").count()
    assert single == cells.where("bad = 1").select("slice").distinct().count()
    loose = fit.fit_project(cells.where("bad = 2"), fit.line_window(cells), small=1000, small_strategy="fixed_r")
    assert 0 < {r.name: r.est for r in loose.collect()}["w"] < 1


@pytest.mark.parametrize("layout", ["windows", "slices"])
def test_lines_are_drawn_to_their_neighbours(spark, layout):
    """no likelihood is lost beyond the tolerance, and the lines vary less."""
    cells = [(2.0, "ref", int(s), int(x), int(n)) for x, s, n in zip(*(lambda c: (c.x, c.s, c.n))(drawn(9, 20_000, 0.8, 2.0, 0.7, 2.0)), strict=True)]
    table = spark.createDataFrame(cells, "bad double, allele string, slice int, x int, n int")
    windows = (qc.slice_windows(table, 4000, 5) if layout == "windows" else fit.slice_window(table)).cache()
    fits = fit.fit_windows(table, windows).cache()
    moved = lines.adjust_lines(table, windows, fits, tolerance=1e-6).cache()
    assert moved.count() == fits.count() and moved.where("adj_nll > nll + 1e-6 * abs(nll) + 1e-9").count() == 0
    before, after = ({(r.slice, r.name): r.est for r in f.collect()} for f in (fits, moved))
    assert {k: v for k, v in before.items() if k[1] == "w"} == {k: v for k, v in after.items() if k[1] == "w"}
    slices = sorted({k[0] for k in before})
    c = sum(q[2] * q[4] for q in cells) / sum(q[4] for q in cells)
    variation = lambda t: sum((c * (t[b, "b"] - t[a, "b"])) ** 2 + (t[b, "mu"] - t[a, "mu"]) ** 2 for a, b in zip(slices, slices[1:], strict=False))
    assert variation(after) < (1 if layout == "windows" else 0.6) * variation(before)
    for r in moved.where("name = 'b'").collect():  # the stated likelihood is that of the moved line
        lo, hi = windows.where(F.col("centre") == r.slice).select("lo", "hi").first()
        held = [c for c in cells if lo <= c[2] <= hi]
        mine = fit.WindowCells(*(np.array([c[i] for c in held], float) for i in (3, 2, 4)), 4)
        line = {"b": after[r.slice, "b"], "mu": after[r.slice, "mu"], "w": after[r.slice, "w"], "p1": 2 / 3, "p2": 1 / 3, "mu_k": 0.0, "b_k": 0.0}
        assert mine.nll(line) == pytest.approx(r.adj_nll, rel=1e-9)
    both = lines.adjusted_logliks(table, fits, moved).agg(F.sum("loglik").alias("a"), F.sum("adj_loglik").alias("b"), F.sum("penalty").alias("c")).first()
    assert both.c == pytest.approx(both.a - both.b, abs=1e-6)
    fixed = fit.fit_windows(table, windows, fixed={"b": 1.0, "mu": 0.0})
    assert {r.est for r in lines.adjust_lines(table, windows, fixed).where("name = 'b'").collect()} == {1.0}


def test_line_mode_takes_the_slice_nearest_to_the_mean(spark):
    obs = spark.createDataFrame([("c", 1, "A", 2.0, "g", x, s) for x, s in ((9, 10), (9, 10), (7, 13), (8, 20))], "chrom string, start int, alt string, bad double, group string, ref_count int, alt_count int")
    params = spark.createDataFrame([(2.0, a, s, 0.5, float(s), 2.0, 3.0) for a in ("ref", "alt") for s in (5, 13, 16)], "bad double, allele string, slice int, b double, mu double, mu_k double, b_k double")
    got = {(r.slice, r.at): (r.r, r.k) for r in lines.line_params(obs, [*diff.SNV, "bad"], params).where("allele = 'ref' AND group = 'g'").collect()}
    # distinct cells: the mean of 10, 13 and 20 is 14.33, so 13 is nearest
    assert got == {(s, 13): (pytest.approx(13 + 0.5 * s), pytest.approx(2 + 3 * math.log(s))) for s in (10, 13, 20)}


def test_symmetrify_is_stable(spark):
    counts = spark.createDataFrame([(1.0, 5, 7, 3), (1.0, 7, 5, 4), (1.0, 6, 6, 5), (1.0, 9, 8, 1)], "bad double, ref_count int, alt_count int, n long")
    once = ingest.symmetrify(counts)
    assert {(r.ref_count, r.alt_count): r.n for r in once.collect()} == {(5, 7): 3, (7, 5): 3, (6, 6): 5, (9, 8): 0, (8, 9): 0}
    assert sorted(ingest.symmetrify(once).collect()) == sorted(once.collect())


def test_slice_windows_are_clipped(spark):
    cells = spark.createDataFrame([(1.0, "ref", s, 10) for s in range(5)], "bad double, allele string, slice int, n long")
    got = {r.centre: (r.lo, r.hi, r.n) for r in qc.slice_windows(cells, 30, 1).collect()}
    assert got == {0: (0, 2, 30), 1: (0, 2, 30), 2: (1, 3, 30), 3: (2, 4, 30), 4: (2, 4, 30)}
    right = {r.centre: (r.lo, r.hi) for r in qc.slice_windows(cells, 30, 1, right=True).collect()}
    assert right == {0: (0, 2), 1: (1, 3), 2: (2, 4), 3: (2, 4), 4: (2, 4)}
    thin = cells.withColumn("n", F.when(F.col("slice") == 3, 4).otherwise(F.col("n")))
    assert sorted(r.centre for r in qc.slice_windows(thin, 30, 1, stop_slice_n=5).collect()) == [0, 1, 2]
    assert {(r.lo, r.hi) for r in qc.slice_windows(cells, 10_000, 1).collect()} == {(0, 4)} and qc.slice_windows(cells.limit(0), 5, 1).count() == 0


def test_registry_is_sound():
    r = registry()
    assert len(r.queries) > 100 and set(r.oracles) <= set(r.queries)


def test_range_join_of_long_and_overlapping_intervals(spark):
    snv = spark.createDataFrame([("c", p) for p in (0, 5, 99_999_999, 100_000_000, 250)], "chrom string, start long")
    bad = spark.createDataFrame([("c", 0, 100_000_000, 2.0, 1), ("c", 250, 251, 4.0, 3), ("c", 200, 300, 3.0, 2), ("c", 7, 7, 9.0, 4)], "chrom string, start long, end long, bad double, map_order int")
    got = {r.start: r.map_bad for r in ingest.range_join_bad(snv, bad).collect()}
    assert got == {0: 2.0, 5: 2.0, 99_999_999: 2.0, 100_000_000: None, 250: 4.0}
    assert {r.map_bad for r in ingest.range_join_bad(snv, bad.limit(0)).collect()} == {None}


def test_files_of_several_headers_maps_and_inputs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#chrom\tpos\tref_counts\talt_counts\tref\talt\nc\t5\t7\t8\tA\tC\n")
    (tmp_path / "b.tsv").write_text("alt\tref\tALT_count\tREF_count\tstart\tchr\tbad\nT\tG\t3\t4\t9\td\t2\n")
    (tmp_path / "c.tsv").write_text("nothing\n1\n")
    (tmp_path / "a.tsv.tbi").write_text("x")
    paths = [str(tmp_path / f"{n}.tsv") for n in "abc"]
    good, bad = files.sort_readable(spark, paths)
    assert good == paths[:2] and [r.path for r in bad.collect()] == paths[2:]
    rows = {r.chrom: (r.start, r.ref_count, r.alt_count, r.ref, r.alt, r.bad) for r in files.read_table(spark, good).collect()}
    assert rows == {"c": (5, 7, 8, "A", "C", 0.0), "d": (9, 4, 3, "G", "T", 2.0)}
    with pytest.raises(ValueError, match="mandatory"):
        files.read_table(spark, paths)
    (tmp_path / "map").write_text("Chrom\tSTART\tend\tBAD\nc\t0\t10\t2\nc\t4\t6\t3\n")
    hit = ingest.range_join_bad(spark.createDataFrame([("c", 5), ("c", 7), ("c", 10)], "chrom string, start long"), files.read_bad_map(spark, str(tmp_path / "map")))
    assert {r.start: r.map_bad for r in hit.collect()} == {5: 3.0, 7: 2.0, 10: None}
    (tmp_path / "list.txt").write_text("b.tsv\na.tsv\n")
    names = lambda patterns: [r.path.rpartition("/")[2] for r in files.resolve_inputs(spark, patterns).orderBy("file_id").collect()]
    assert names([f"m:{tmp_path}/[ab].tsv"]) == ["a.tsv", "b.tsv"]
    assert names([str(tmp_path / "list.txt")]) == ["a.tsv", "b.tsv"]
    assert names([str(tmp_path), str(tmp_path / "a.tsv")]) == ["a.tsv", "b.tsv", "c.tsv", "list.txt", "map"]
    with pytest.raises(FileNotFoundError):
        names([str(tmp_path / "absent")])


def test_short_names(spark):
    names = ["/data/run/x/one.vcf.gz", "/data/run/y/two.tsv", "/data/run/y/three.bam.txt"]
    got = [r.scorefile for r in export.short_names(spark.createDataFrame([(n,) for n in names], "scorefile string")).collect()]
    assert got == ["x/one", "y/two", "y/three.bam.txt"]
    assert [r.scorefile for r in export.short_names(spark.createDataFrame([("a.tsv",)], "scorefile string")).collect()] == ["a"]
    assert export.short_names(spark.createDataFrame([], "scorefile string")).count() == 0


def test_selected_snvs_that_are_missing(spark):
    snvs = spark.createDataFrame([("rs1", "A"), ("rs2", "C")], "id string, alt string")
    wanted = spark.createDataFrame([("rs1", "A"), ("rs9", "C")], "id string, alt string")
    assert [r.id for r in ingest.select_snvs(snvs, wanted, ["id", "alt"]).collect()] == ["rs1"]
    assert [r.id for r in ingest.missing_snvs(snvs, wanted, ["id", "alt"]).collect()] == ["rs9"]
    with pytest.raises(ValueError, match="rs9"):
        ingest.select_snvs(snvs, wanted, ["id", "alt"], strict=True)
    with pytest.raises(ValueError, match="more than one group"):
        diff.require_disjoint(spark.createDataFrame([("a", "f"), ("b", "f")], "group string, scorefile string"))


def test_differential_tests_by_hand(spark):
    """G2, G9, G11, G13 and G14 on fits whose p and likelihood are given."""
    rows = [("k", a, g, n, p, nll, 0.01) for a in ("ref", "alt") for g, n, p, nll in (("c", 10, 0.6, 20.0), ("t", 12, 0.4, 30.0), (diff.ALL, 22, 0.5, 53.0))]
    fits = spark.createDataFrame(rows, "k string, allele string, group string, n long, p double, nll double, var double")
    chi = lambda x: math.erfc(math.sqrt(x / 2))  # noqa: E731 - one degree of freedom
    both = diff.lrt(fits, ["k"]).where("allele = 'ref'").first()
    assert (both.stat, both.groups, both.n_all, both.p_all) == (6.0, 2, 22, 0.5) and both.pval == pytest.approx(chi(6.0))
    pair = diff.lrt_pair(fits, ["k"], "c", "t").where("allele = 'ref'").first()
    assert (pair.n_control, pair.n_test, pair.p_control, pair.p_test) == (10, 12, 0.6, 0.4) and pair.pval == pytest.approx(chi(6.0))
    assert diff.lrt(fits.where("group <> 't'"), ["k"]).count() == 0  # one group is no test
    wide = diff.alleles_wide(diff.wald(fits, ["k"], "c", "t"), ["k"], ["p_control", "p_test", "pval"]).withColumns({"ref_fdr_pval": F.lit(0.2), "alt_fdr_pval": F.lit(0.3)})
    r = diff.derived(wide).first()
    assert r.ref_es_p == pytest.approx(math.log2(0.4 / 0.6)) and r.scoring_model == "alt|ref" and r.fdr_pval == 0.3 and r.pref_allele_control == "alt"
    cells = spark.createDataFrame([("k", "ref", "c", 4, [(9, 7.0, 3), (12, 8.0, 1)])], "k string, allele string, group string, n long, cells array<struct<x int, r double, n long>>")
    mean = lambda r, p: sum(x * w for x, w in nb(r, p)) / sum(w for _, w in nb(r, p))
    nb = lambda r, p: [(x, math.exp(math.lgamma(x + r) - math.lgamma(r) - math.lgamma(x + 1) + x * math.log(p) + r * math.log(1 - p))) for x in range(5, 400)]
    (effect,) = diff.mean_effect(fits, cells, ["k"]).collect()
    assert effect.es == pytest.approx((3 * math.log2(mean(7, 0.6) / mean(7, 0.5)) + math.log2(mean(8, 0.6) / mean(8, 0.5))) / 4)
    own = float(cells_of([[(9, 7.0, 3), (12, 8.0, 1)]]).nll(np.array([0.6]))[0])
    got = diff.pairwise(fits.withColumn("nll", F.lit(own)), cells, ["k"]).first()
    pooled = float(cells_of([[(9, 7.0, 3), (12, 8.0, 1)]]).nll(np.array([0.5]))[0])
    assert got.pval == pytest.approx(chi(max(0.0, 2 * (pooled - own))))


def test_false_discovery_rates_in_many_ranges(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.random(700) ** 4, np.full(300, 1.0), np.full(50, 1e-30), np.zeros(3)])
    df = spark.createDataFrame([(float(v),) for v in p], "p double")
    order = np.sort(p)
    rank = np.searchsorted(order, order, side="right")
    want = dict(zip(order.tolist(), np.minimum.accumulate((order * len(p) / rank)[::-1])[::-1].clip(max=1).tolist(), strict=True))
    for parts in (1, 7, 200):
        assert {r.p: r.q for r in combine.fdr(df, "p", "q", parts=parts).collect()} == pytest.approx(want)


def test_stored_sets_and_their_groups(spark):
    """A12 and G10: the default set, the only set, a named one, and the groups of named ones."""
    table = lambda *files: spark.createDataFrame([(f,) for f in files], "scorefile string")
    one, two = store.new_dir(spark, "sets"), store.new_dir(spark, "sets")
    store.upsert(table("a", "b"), one, "01")
    for name, part in ((None, table("c")), ("x", table("d", "d"))):
        store.upsert(part, two, name)
    files = lambda path, name=None: {r.scorefile for r in store.chosen_set(spark, path, name).collect()}
    assert files(one) == files(one, "01") == {"a", "b"} and files(two) == {"c"} and files(two, "x") == {"d"}
    with pytest.raises(KeyError, match="no set y"):
        files(two, "y")
    store.upsert(table("e"), one, "1")
    with pytest.raises(KeyError, match="several sets"):
        files(one)
    assert files(one, "01") == {"a", "b"} and files(one, "1") == {"e"}  # names stay text
    assert {tuple(r) for r in diff.stored_groups(spark, two).collect()} == {("x", "d")}
    assert {r.scorefile for r in export.stored_members(spark, [two, two]).collect()} == {"[0] c", "[1] c"}


def test_binomial_tests_of_large_counts_and_small_ones(spark):
    counts = spark.createDataFrame([(2.0, 5, 5), (2.0, 400, 500), (2.0, 4, 9), (2.0, 400, 500)], "bad double, ref_count int, alt_count int")
    got = {(r.ref_count, r.alt_count): r for r in score.binomial_test(counts, w=0.7).collect()}
    assert set(got) == {(5, 5), (400, 500)} and got[5, 5].ref_pval == got[5, 5].alt_pval == 1.0
    whole = lambda p: [math.exp(math.lgamma(901) - math.lgamma(i + 1) - math.lgamma(901 - i) + i * math.log(p) + (900 - i) * math.log(1 - p)) for i in range(5, 896)]
    want = sum(w * sum(whole(p)[395:]) / sum(whole(p)) for w, p in ((0.7, 2 / 3), (0.3, 1 / 3)))
    assert got[400, 500].ref_pval == pytest.approx(want, rel=1e-9)


def test_score_lists_keep_the_order_of_the_input_where_keys_tie(spark, tmp_path):
    """D13: rows of one sample and row_order are listed as their files, by name, and the rows in them."""
    (folder := tmp_path / "lineitem.parquet").mkdir()
    files_of = {"a": (43, 19), "b": (50, 8, 30, 11, 27, 30)}  # Spark reads the larger file first
    for name, counts in files_of.items():
        keys = {"l_orderkey": 1294, "l_partkey": 123, "l_suppkey": 0, "l_linenumber": 4, "l_returnflag": "N"}
        pq.write_table(pa.table({**{k: [v] * len(counts) for k, v in keys.items()}, "l_quantity": [float(x) for x in counts]}), folder / f"{name}.parquet")
    (got,) = registry().queries["d13_score_lists"](spark, str(tmp_path)).collect()
    pairs = [(2.0, x, 30) for counts in files_of.values() for x in counts]
    scores = {r.ref_count: r for r in score.binomial_test(spark.createDataFrame(pairs, "bad double, ref_count int, alt_count int")).collect()}
    for c in ("ref_pval", "ref_es", "alt_pval", "alt_es"):
        assert [float(v) for v in got[f"{c}s"].split(",")] == pytest.approx([scores[x][c] for _, x, _ in pairs], abs=6e-4)
