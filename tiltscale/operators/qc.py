"""Quality tables: scorefiles, slices, profiles; and joins of parameters by slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import score

ALLELE = ["bad", "allele"]


def scorefile_qc(obs: DataFrame) -> DataFrame:
    """Coverage and share of ref > alt per scorefile and BAD, and per scorefile (bad null)."""
    sets = obs.groupingSets([["scorefile", "bad"], ["scorefile"]], "scorefile", "bad")
    return sets.agg(F.sum(F.col("ref_count") + F.col("alt_count")).alias("cover"), F.avg((F.col("ref_count") > F.col("alt_count")).cast("double")).alias("bias")).where("cover > 0")


def outliers(qc: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Scorefiles whose bias is more than so many population deviations from the mean."""
    whole = qc.where("bad IS NULL")
    stats = whole.agg(F.avg("bias").alias("m"), F.stddev_pop("bias").alias("sd"))
    return whole.join(F.broadcast(stats)).where(F.abs(F.col("bias") - F.col("m")) > deviations * F.col("sd")).select("scorefile", "bias")


def heat_map(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where((F.col("ref_count") < limit) & (F.col("alt_count") < limit)).withColumn("value", F.log10(1 + F.col("n")))


def slice_histogram(oriented: DataFrame) -> DataFrame:
    """Normalised counts within each slice."""
    w = Window.partitionBy("bad", "allele", "slice")
    return oriented.withColumn("share", F.col("n") / F.sum("n").over(w))


def slice_windows(oriented: DataFrame, window_size: int, min_slices: int, stop_slice_n: int = 0, right: bool = False) -> DataFrame:
    """bad, allele, centre, lo, hi, n: each slice's smallest window of enough observations and slices.

    Windows count slices present. They grow both ways, clipped at both ends, or with
    ``right`` to the right, and to the left only where the right end is too early; the full
    range always does. Centres start at the lowest slice and stop before the first with
    fewer than ``stop_slice_n`` observations. The smallest radius is found by bisection on
    running sums, held as one array per (BAD, allele): a few hundred slices.
    """
    per = oriented.groupBy(*ALLELE, "slice").agg(F.sum("n").alias("n"))
    one = per.groupBy(*ALLELE).agg(F.sort_array(F.collect_list(F.struct("slice", "n"))).alias("s"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slices, n = (np.array([c[f] for c in row["s"]], np.int64) for f in ("slice", "n"))
                m, cum = len(n), np.concatenate([[0], np.cumsum(n)])
                i = np.arange(m)

                def ends(radius: np.ndarray, i: np.ndarray = i, m: int = m) -> tuple[np.ndarray, np.ndarray]:
                    if right:  # what does not fit on the right goes to the left
                        b = np.minimum(i + radius, m - 1)
                        return np.maximum(i - (radius - (b - i)), 0), b
                    return np.maximum(i - radius, 0), np.minimum(i + radius, m - 1)

                low, high = np.zeros(m, np.int64), np.full(m, m)
                while (low < high).any():
                    mid = (low + high) // 2
                    a, b = ends(mid)
                    enough = (cum[b + 1] - cum[a] >= window_size) & (b - a + 1 >= min_slices)
                    high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
                a, b = ends(high)
                stop = int(np.argmax(n < stop_slice_n)) if (n < stop_slice_n).any() else m
                yield pa.RecordBatch.from_pydict({
                    "bad": pa.array([row["bad"]] * stop, pa.float64()), "allele": pa.array([row["allele"]] * stop, pa.string()), "centre": pa.array(slices[:stop], pa.int32()),
                    "lo": pa.array(slices[a][:stop], pa.int32()), "hi": pa.array(slices[b][:stop], pa.int32()), "n": pa.array((cum[b + 1] - cum[a])[:stop], pa.int64()),
                })

    return one.mapInArrow(windows, "bad double, allele string, centre int, lo int, hi int, n long")


def nearest_params(wanted: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters of the nearest slice within (bad, allele); ties go to the earlier in fit order."""
    known = params.withColumnRenamed("slice", "at")
    met = wanted.select(*ALLELE, "slice").distinct().join(known, ALLELE)
    fields = [c for c in known.columns if c not in (*ALLELE, "at", "fit_order")]
    best = met.groupBy(*ALLELE, "slice").agg(F.min_by(F.struct("at", *fields), F.struct(F.abs(F.col("at") - F.col("slice")), "fit_order")).alias("b"))
    return best.select(*ALLELE, "slice", "b.*")


def evaluate_params(params: DataFrame) -> DataFrame:
    """r = mu + b * slice and k = mu_k + b_k * slice."""
    return params.withColumn("r", F.col("mu") + F.col("b") * F.col("slice")).withColumn("k", F.col("mu_k") + F.col("b_k") * F.col("slice"))


def fit_stats(oriented: DataFrame, expected: DataFrame, free: int = 0) -> DataFrame:
    """n, chi2 and rmsea per slice against the model's pmf; cells never seen count by their expectation.

    rmsea is sqrt(max(chi2 / df - 1, 0) / (n - 1)), df the cells less one and the free
    parameters: the published definition, stated as our choice.
    """
    keys = [*ALLELE, "slice"]
    total = oriented.groupBy(*keys).agg(F.sum("n").alias("total"))
    met = oriented.join(expected.select(*keys, "x", "pmf"), [*keys, "x"]).join(total, keys).withColumn("e", F.col("pmf") * F.col("total"))
    agg = met.groupBy(*keys, "total").agg(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("c"), F.sum("e").alias("e"), F.count("*").alias("cells"))
    chi2 = F.col("c") + F.col("total") - F.col("e")
    df = F.greatest(F.col("cells") - free, F.lit(1))
    return agg.select(*keys, F.col("total").alias("n"), chi2.alias("chi2"), F.sqrt(F.greatest(chi2 / df - 1, F.lit(0.0)) / F.greatest(F.col("total") - 1, F.lit(1))).alias("rmsea"))


def pile_up(reads: DataFrame, snvs: DataFrame, bin_size: int = 64) -> DataFrame:
    """Per SNV: reads of either base, all original reads, failed mappings and failed genotypings.

    A read name counts once; the base of read 1 is preferred. Reads meet SNVs by bins of
    positions; ``remapped`` marks reads that are still placed after remapping.
    """
    spans = reads.withColumn("bin", F.explode(F.sequence(F.expr(f"floor(pos / {bin_size})"), F.expr(f"floor((pos + length(seq) - 1) / {bin_size})"))))
    met = snvs.withColumn("bin", F.expr(f"floor(start / {bin_size})")).join(spans, ["contig", "bin"]).where("start >= pos and start < pos + length(seq)")
    base = met.withColumn("base", F.expr("substring(seq, cast(start - pos + 1 as int), 1)"))
    key = ["contig", "start", "ref", "alt"]
    per = base.groupBy(*key, "read_name").agg(
        F.max(F.when(F.col("remapped") & F.col("is_read1"), F.col("base"))).alias("b1"), F.max(F.when(F.col("remapped") & ~F.col("is_read1"), F.col("base"))).alias("b2")
    ).withColumn("b", F.coalesce("b1", "b2"))
    return per.groupBy(*key).agg(
        F.count_if(F.col("b") == F.col("ref")).alias("n_ref"), F.count_if(F.col("b") == F.col("alt")).alias("n_alt"), F.count("*").alias("n_original"), F.count_if(F.col("b").isNull()).alias("failed_mapping"),
        F.count_if(F.col("b").isNotNull() & (F.col("b") != F.col("ref")) & (F.col("b") != F.col("alt"))).alias("failed_genotyping"),
    )


#: Counts of a sample at a variant.
COUNTS = ("n_ref", "n_alt", "n_total", "failed_mapping", "failed_genotyping", "failed_bias")


def recode(genotypes: DataFrame, samples: DataFrame, counts: DataFrame) -> DataFrame:
    """Per variant and sample its counts where the genotype is heterozygous, else zeros.

    genotypes: contig, start, ref, alt, individual, gt (1: heterozygous; null or else: not);
    counts: sample, contig, start, ref, alt and ``COUNTS``. Counts meet the variant by place
    and alleles, and the first of several rows is taken.
    """
    site = ["sample", "contig", "start", "ref", "alt"]
    first = counts.groupBy(*site).agg(F.min(F.struct(*COUNTS)).alias("c"))
    met = genotypes.join(samples, "individual").join(first, site, "left")
    het = F.coalesce(F.col("gt") == 1, F.lit(False))
    return met.select("contig", "start", "ref", "alt", "sample", *[F.when(het, F.coalesce(f"c.{c}", F.lit(0))).otherwise(0).cast("long").alias(c) for c in COUNTS])


def mismatched(genotypes: DataFrame, samples: DataFrame, counts: DataFrame) -> DataFrame:
    """Sites whose counts are of other alleles than the heterozygous genotype's only; a sound table gives none."""
    site = ["sample", "contig", "start"]
    het = genotypes.where("gt = 1").join(samples, "individual")
    known = counts.groupBy(*site).agg(F.collect_set(F.struct("ref", "alt")).alias("alleles"))
    return het.join(known, site).where(~F.array_contains("alleles", F.struct("ref", "alt"))).select(*site, "ref", "alt")


def sample_arrays(recoded: DataFrame) -> DataFrame:
    """Per variant the samples' fields in sample order, where any allele was counted.

    ad: both counts; ard: their sum; rd: all reads; fm, fg, fb: failures of mapping,
    genotyping and bias; fmr: the share of reads that failed mapping, zero without reads.
    """
    both = F.col("n_ref") + F.col("n_alt")
    share = F.when(F.col("n_total") == 0, 0.0).otherwise(F.col("failed_mapping") / F.greatest("n_total", F.lit(1)))
    one = F.struct("sample", F.concat_ws("|", "n_ref", "n_alt").alias("ad"), both.alias("ard"), F.col("n_total").alias("rd"), F.col("failed_mapping").alias("fm"), F.col("failed_genotyping").alias("fg"), F.col("failed_bias").alias("fb"), share.alias("fmr"))
    rows = recoded.groupBy("contig", "start", "ref", "alt").agg(F.array_sort(F.collect_list(one)).alias("l"), F.sum(both).alias("total")).where("total > 0")
    return rows.select("contig", "start", "ref", "alt", "total", *[F.concat_ws(",", F.col(f"l.{c}").cast("array<string>")).alias(c) for c in ("ad", "ard", "rd", "fm", "fg", "fb", "fmr")])


def effect_profile(scored: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Per SNV, group and allele: replicates' mean and population variance of log2 of the
    counts' ratio and of the scored effect size.

    With ``tests`` (chrom, start, alt, allele, group, p, p_all, pval, fdr_pval) also log2 of
    p against all groups' p, whether both p-values are below 0.05, and the rank by the ratio.
    """
    ratio = F.log2(F.col("ref_count") / F.col("alt_count"))
    sides = F.array(*[F.struct(F.lit(a).alias("allele"), sign.alias("ratio"), F.col(f"{a}_es").alias("es")) for a, sign in (("ref", ratio), ("alt", -ratio))])
    keys = ["chrom", "start", "alt", "group", "allele"]
    rows = scored.select("chrom", "start", "alt", "group", F.inline(sides)).groupBy(*keys).agg(
        F.avg("ratio").alias("mean_ratio"), F.var_pop("ratio").alias("var_ratio"), F.avg("es").alias("mean_es"), F.var_pop("es").alias("var_es")
    )
    if tests is None:
        return rows
    known = tests.select(*keys, (F.log2("p") - F.log2("p_all")).alias("log_p"), (F.col("pval") < 0.05).alias("low"), (F.col("fdr_pval") < 0.05).alias("fdr_low"))
    place = Window.partitionBy("chrom", "start", "alt", "allele").orderBy("mean_ratio", "group")
    return rows.join(known, keys, "left").withColumn("place", F.row_number().over(place))


def slice_density(oriented: DataFrame, params: DataFrame, left: int = 4, by_sum: bool = False) -> DataFrame:
    """Share of each count within its slice, or its total coverage, next to the fitted mixture's pmf there."""
    within = F.col("slice") + F.col("x") if by_sum else F.col("slice")
    rows = oriented.withColumn("within", within)
    rows = rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*ALLELE, "within"))).join(params.select(*ALLELE, "slice", "r", "w", "p1", "p2"), [*ALLELE, "slice"])
    for side in ("1", "2"):
        rows = score.with_tails(rows, left, "nb", f"p{side}", side)
    pmf = F.col("w") * F.exp("logpmf1") + (1 - F.col("w")) * F.exp("logpmf2")
    return rows.select(*ALLELE, "slice", "x", "n", "share", pmf.alias("pmf"))


def parameter_profile(params: DataFrame, top: int | None = None) -> DataFrame:
    """Every slice from 0 to ``top`` (the largest there is), with its nearest parameters evaluated.

    params: bad, allele, slice, b, mu, b_k, mu_k, p1, p2, fit_order and, if known, std_k.
    Gives r, k, 1 / k with its error, p1 + p2, p1's share of it, and the expected
    bad / (bad + 1) and 1 / (bad + 1).
    """
    ends = params.groupBy(*ALLELE).agg(F.max("slice").alias("top"))
    grid = ends.select(*ALLELE, F.explode(F.sequence(F.lit(0), F.lit(top) if top is not None else F.col("top"))).alias("slice"))
    at = evaluate_params(nearest_params(grid, params))
    inverse = F.try_divide(F.lit(1.0), F.col("k"))
    error = F.col("std_k") * inverse * inverse if "std_k" in params.columns else F.lit(None).cast("double")
    b = F.col("bad")
    return at.select(*ALLELE, "slice", "r", "k", inverse.alias("inv_k"), error.alias("std_inv_k"), (F.col("p1") + F.col("p2")).alias("p_sum"), (F.col("p1") / (F.col("p1") + F.col("p2"))).alias("p_share"), (b / (b + 1)).alias("expected_p1"), (1 / (b + 1)).alias("expected_p2"))
