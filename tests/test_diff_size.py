"""Work and memory of differential tests: how often terms are evaluated, moments by series, partitions by size."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tiltscale.functions import moments, truncated
from tiltscale.operators import combine, diff, lines


def _lists(problems, dist, seed=0):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 18, problems)
    x, r = rng.integers(5, 51, sizes.sum()), rng.integers(5, 51, sizes.sum()).astype(float)
    fields = {"x": x, "r": r} | ({"k": np.full(len(x), 6000.0)} if dist == "betanb" else {}) | {"n": np.ones(len(x), np.int64)}
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


@pytest.mark.parametrize("dist", truncated.DISTS)
def test_search_evaluates_few_problems_again(dist, monkeypatch):
    lists, seen, terms = _lists(400, dist), [], diff.Cells.terms
    cells = diff.Cells(lists, dist)
    monkeypatch.setattr(diff.Cells, "terms", lambda self, p: seen.append(len(p)) or terms(self, p))
    p, nll, var, _ = cells.mle()
    assert sum(seen) < 5 * 400  # 66 times all before
    inside = (p > 1e-6) & (p < 1 - 1e-6)
    t = terms(cells, p)
    step = cells.total(cells.n * t.slope)[inside] * var[inside]
    assert inside.sum() > 390 and np.nanmax(np.abs(step)) < 1e-11  # the score is zero there
    for g in diff.GRID:
        assert (nll <= cells.nll(np.full(400, g)) + 1e-9).all()
    np.testing.assert_allclose(nll, -cells.total(cells.n * t.value), rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("dist", ["betanb", "mcnb"])
def test_search_takes_terms_from_series(dist, monkeypatch):
    rng, n = np.random.default_rng(2), 4000
    sizes = rng.integers(6, 18, n)
    fields = {"x": rng.integers(5, 13, sizes.sum()), "r": rng.integers(5, 13, sizes.sum()).astype(float), "k": np.full(sizes.sum(), 6000.0), "n": np.ones(sizes.sum(), np.int64)}
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))
    cells, seen, terms = diff.Cells(lists, dist), [], truncated.Likelihood.terms
    monkeypatch.setattr(truncated.Likelihood, "terms", lambda self, p: seen.append(len(p)) or terms(self, p))
    tables = diff.Tables(dist)
    p, nll, var, sandwich = cells.mle(tables=tables)
    assert sum(seen) < len(cells.likelihood.r)  # more than twice as many before: each cell's terms anew at each step
    assert tables.made > 100
    monkeypatch.setattr(truncated.Likelihood, "terms", terms)
    t, inside = cells.terms(p), (p > 1e-6) & (p < 1 - 1e-6)
    assert np.nanmax(np.abs(cells.total(cells.n * t.slope)[inside] * var[inside])) < 1e-11  # the score is zero there
    np.testing.assert_allclose(nll, -cells.total(cells.n * t.value), rtol=1e-10, atol=1e-10)
    np.testing.assert_allclose(var[inside], -1 / cells.total(cells.n * t.bend)[inside], rtol=1e-9)
    at = rng.uniform(0.0001, 0.9999, n)  # some beyond all panels
    np.testing.assert_allclose(cells.nll(at, tables), cells.nll(at), rtol=1e-10)


def test_compound_probabilities_at_small_p():
    # all counts just above the truncation: their probability tends to one as p falls, and never passes it
    cells = truncated.Likelihood("mcnb", np.array([5.0, 6.0, 5.0]), np.array([0, 0, 1]), np.array([40.0, 7.0]), None, 4)
    for p in (1e-2, 1e-3, 1e-4, 1e-6):
        value = cells.terms(np.full(2, p)).value
        assert (value <= 0).all() and abs(value[0]) < 50 * p and value[1] < value[0]


@pytest.mark.parametrize("dist", truncated.DISTS)
def test_moments_by_series(dist):
    rng = np.random.default_rng(1)
    r, k = rng.choice([0.7, 5, 50], 3000), rng.choice([30.0, 6000.0], 3000) if dist == "betanb" else np.zeros(3000)
    p = 1 / (1 + np.exp(-rng.uniform(-3, 2, 3000)))
    asked = truncated.Likelihood(dist, np.empty(0), np.empty(0, np.int64), r, k, 4)
    panels = moments.Panels(dist)
    got, want = panels.at(asked, p), moments.log2_moments(asked, p)
    assert 30 <= len(panels.rows) <= 66
    for name in ("first", "variance"):
        np.testing.assert_allclose(getattr(got, name), getattr(want, name), atol=2e-11)
    np.testing.assert_allclose(got.mean, want.mean, rtol=2e-11)


def test_partitions_grow_with_observations(spark, monkeypatch):
    monkeypatch.setattr(diff, "ROWS", 500)
    rows = spark.range(4000).select(F.lit("chr1").alias("chrom"), (F.col("id") % 400).alias("start"), F.lit("A").alias("alt"), F.lit(1.0).alias("bad"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("group"), (F.col("id") % 40 + 5).cast("int").alias("ref_count"), (F.col("id") % 31 + 5).cast("int").alias("alt_count"))
    dealt = diff.placed(rows)
    assert dealt.rdd.getNumPartitions() == 8
    kept = diff.gate_groups(diff.gate_samples(dealt, 2), 2)
    found = diff.problems(kept, [*diff.SNV, "bad"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # dealt once, then no shuffle
    sizes = found.groupBy("group", "allele").agg(F.sum("n")).collect()
    assert {(g, a): n for g, a, n in sizes} == {(g, a): n for g, n in (("a", 1334), ("b", 2666), (diff.ALL, 4000)) for a in ("ref", "alt")}


def test_observations_are_not_dealt_by_scorefile(spark):
    obs = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 3).alias("scorefile"), F.lit(5).alias("ref_count"), F.lit(6).alias("alt_count"))
    groups = spark.createDataFrame([("a", "s0"), ("b", "s1")], "group string, scorefile string")
    found = diff.with_groups(obs, groups)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["group"]: r["count"] for r in found.groupBy("group").count().collect()} == {"a": 34, "b": 33}


def test_replicates_are_not_dealt_by_project(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("project"), F.col("id").alias("ref_count"), F.lit(0).alias("alt_count"))
    found = combine.gate_each(rows, spark.createDataFrame([(0, 50), (1, 90)], "project long, threshold int"), ["project"])
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["project"]: r["count"] for r in found.groupBy("project").count().collect()} == {0: 25, 1: 5}


@pytest.mark.parametrize("dist", truncated.DISTS)
def test_all_problems_of_an_snv_in_one_pass(spark, dist):
    keys = [*diff.SNV, "bad"]
    rows = spark.range(900).select(F.lit("chr1").alias("chrom"), (F.col("id") % 30).alias("start"), F.lit("A").alias("alt"), F.lit(1.5).alias("bad"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 7 % 3 + 1).cast("int")).alias("group"), (F.col("id") * 7 % 11 + 5).cast("int").alias("ref_count"), (F.col("id") * 5 % 13 + 5).cast("int").alias("alt_count"))
    found = diff.fit_groups(diff.placed(rows), keys, dist=dist, against=True, effect="entropy")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # fits met their cells in three shuffled joins before
    # cells gathered by Spark, fitted and tested one step after the other
    cells = diff.problems(rows, keys, dist=dist).cache()
    fits = diff.fit_p(cells, dist=dist).cache()
    name = lambda df: {(r.start, r.allele, r.group): r for r in df.collect()}
    got, want = name(found), name(fits)
    pairs, effects, moved = name(diff.pairwise(fits, cells, keys, dist=dist)), name(diff.entropy_effect(fits, cells, keys, dist=dist)), name(diff.against_all(found, keys))
    assert got.keys() == want.keys() and pairs.keys() == effects.keys() == moved.keys()
    for key, r in got.items():
        w = want[key]
        assert r.n == w.n and (r.p, r.nll, r["var"]) == pytest.approx((w.p, w.nll, w["var"]), rel=1e-9)
        if key in pairs:
            assert moved[key].pval == pytest.approx(pairs[key].pval, abs=1e-9) and r.p_all == want[*key[:2], diff.ALL].p
            assert (r.es, r.es_var) == pytest.approx((effects[key].es, effects[key].es_var), abs=1e-9)
        else:
            assert r.p_all is None and r.es is None
    assert diff.fit_groups(rows.limit(0), keys, dist=dist, against=True, effect="mean").count() == 0


def test_rates_take_running_minima(spark):
    # a frame that ends unbounded is gone through anew for each row: 34 s for one task of 240,000 values before
    found = combine.fdr(spark.range(500).select(((F.col("id") * 37 % 500 + 1) / 500).alias("p")), "p", "q", parts=3)
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert set(re.findall(r"rowframe, (\S+), unboundedfollowing", plan)) <= {"unboundedpreceding$()"} and "rowframe, unboundedpreceding" in plan
    assert all(r.q == pytest.approx(1.0) for r in found.collect())  # p of rank k is k / 500
    found = combine.fdr(spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.005, 0.9, None)], "p double"), "p", "q", parts=2)
    assert {r.p: r.q for r in found.collect()} == pytest.approx({0.005: 0.025, 0.01: 0.025, 0.03: 0.05, 0.04: 0.05, 0.9: 0.9, None: None})


def test_line_parameters_once_a_combination(spark):
    obs = spark.range(300).select(F.lit("chr1").alias("chrom"), (F.col("id") % 50).alias("start"), F.lit("A").alias("alt"), F.lit(2.0).alias("bad"), F.lit("g").alias("group"), (F.col("id") % 7 + 5).cast("int").alias("ref_count"), (F.col("id") % 11 + 5).cast("int").alias("alt_count"))
    params = spark.createDataFrame([(2.0, a, s, 1.0, 0.5, 0.9, 20.0, 0.5, 0.7) for a in ("ref", "alt") for s in (5, 8, 11)], "bad double, allele string, slice long, b double, mu double, slice_power double, mu_k double, b_k double, w double")
    found = lines.line_params(obs, [*diff.SNV, "bad"], params)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the long expressions stand above the distinct combinations that are sent to the tasks, not above the problems' rows
    assert "POWER" not in plan.split("BroadcastExchange")[0].upper() and "POWER" in plan.upper()
    got = found.where("group = 'g'").collect()
    cells = {}
    for r in obs.collect():
        for allele, x, s in (("ref", r.ref_count, r.alt_count), ("alt", r.alt_count, r.ref_count)):
            cells.setdefault((r.start, allele), set()).add((x, s))
    assert {(r.start, r.allele, r.slice) for r in got} == {(*k, s) for k, v in cells.items() for _, s in v}
    for r in got:
        mean = np.mean([s for _, s in cells[r.start, r.allele]])
        assert r["at"] == (round(mean) if round(mean) in (5, 8, 11) else min((5, 8, 11), key=lambda s: (abs(s - mean), s)))
        assert r.k == pytest.approx(20 + 0.5 * np.log(r.slice))


def test_stored_groups_write_observations_alone(spark, monkeypatch):
    from tiltscale.queries import registry

    tags, settle = [], diff.settle
    monkeypatch.setattr(diff, "settle", lambda df, tag="stage": tags.append(tag) or settle(df, tag))
    found = registry().queries["g10_anova_stored_groups"](spark, "/root/testdata/sf0.001")
    assert tags == ["observations"]
    assert sorted(map(str, found.collect())) == sorted(map(str, registry().queries["g10_anova"](spark, "/root/testdata/sf0.001").collect()))
