"""Combining scores over replicates, and false discovery rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..sources.store import settle

SNV = ["chrom", "start", "alt"]
PAIR = ["bad", "ref_count", "alt_count"]


def with_scores(obs: DataFrame, scores: DataFrame, how: str = "inner") -> DataFrame:
    """Observations with the scores of their count pair; a left join fills a miss with p = 1, es = 0.

    The scores hold one row per distinct pair; the optimizer broadcasts them when they
    are small and shuffles otherwise.
    """
    out = obs.join(scores, PAIR, how)
    if how == "left":
        out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("ref_pval", 1.0), ("alt_pval", 1.0), ("ref_es", 0.0), ("alt_es", 0.0))})
    return out


def in_group(obs: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Rows of the scorefiles a group names: ``m:`` masks, exact names or folders; none: every file."""
    if not patterns:
        return obs
    cond = F.lit(False)
    for p in patterns:
        if p.startswith("m:"):
            cond = cond | F.col("scorefile").rlike("^" + mask_regex(p[2:]) + "$")
        else:
            cond = cond | (F.col("scorefile") == p) | F.col("scorefile").startswith(p.rstrip("/") + "/")
    return obs.where(cond)


def mask_regex(mask: str) -> str:
    """A file mask's pattern: * and ? match within the name, [..] a set of letters."""
    out, i = "", 0
    while i < len(mask):
        c = mask[i]
        end = mask.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = mask[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
        i += 1
    return out


def coverage_thresholds(scores: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Per BAD the least coverage at which either allele can be significant; infinite where none can."""
    cover = F.col("ref_count") + F.col("alt_count")
    least = [F.coalesce(F.min(F.when((F.col(f"{a}_es") > cutoff) & (F.col(f"{a}_pval") < cutoff), cover)).cast("double"), F.lit(float("inf"))) for a in ("ref", "alt")]
    return scores.groupBy("bad").agg(F.least(*least).alias("threshold"))


def gate_any(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """SNVs with any replicate at its BAD's threshold, with all their replicates."""
    # one pass: every row's SNV tells whether any of its replicates is at the threshold
    rows = scored.join(F.broadcast(thresholds), "bad", "left")
    any_met = F.max(F.coalesce(F.col("ref_count") + F.col("alt_count") >= F.col("threshold"), F.lit(False))).over(Window.partitionBy(*SNV))
    return rows.withColumn("__met", any_met).where("__met").drop("threshold", "__met").select(*scored.columns)


def gate_each(scored: DataFrame, thresholds: DataFrame, on: list[str]) -> DataFrame:
    """Replicates at their threshold only; ``thresholds``, a row each, go to all tasks, as few projects would be few large tasks."""
    return scored.join(F.broadcast(thresholds), on).where(F.col("ref_count") + F.col("alt_count") >= F.col("threshold")).drop("threshold")


def logit_pvalue(total: Column, k: Column, one: Column, fisher: Column) -> Column:
    """Combined p of ``k`` p-values below one, from total = sum(-ln p + ln(1 - p)).

    Without any it is one; of one it is that p; a tail of zero falls back to Fisher's sum.
    Both sums are infinite if a p is zero, and the combined p is then zero.
    """
    df = 5 * k + 4
    some = F.greatest(k, F.lit(1))
    t = special.t_sf(total * F.sqrt(3 * df / (some * math.pi**2 * (df - 2))), df.cast("double"))
    return F.when(k == 0, 1.0).when(k == 1, one).when(F.isnan(total) | (total == float("inf")), 0.0).otherwise(F.when(t > 0, t).otherwise(fisher))


def combine(scored: DataFrame, uniform: bool = True, by: list[str] | None = None) -> DataFrame:
    """Per SNV the combined p-value and effect size of both alleles: one shuffle by SNV."""
    by = by or SNV
    aggs, out = [], []
    for a in ("ref", "alt"):
        p, es = F.col(f"{a}_pval"), F.col(f"{a}_es")
        below, minus_log = p < 1, F.when(p > 0, -F.log(p)).otherwise(float("inf"))
        weight = F.when(p > 0, -F.log10(p))
        aggs += [
            F.sum(F.when(below, minus_log + F.log1p(-p))).alias(f"{a}_t"), F.count(F.when(below, 1)).alias(f"{a}_k"), F.max(F.when(below, p)).alias(f"{a}_one"),
            F.sum(F.when(below, 2 * minus_log)).alias(f"{a}_fisher"), F.avg(es).alias(f"{a}_mean"), F.sum(weight * es).alias(f"{a}_wes"), F.sum(weight).alias(f"{a}_w"),
        ]
        fisher = special.chi2_sf_even(F.col(f"{a}_fisher"), F.col(f"{a}_k"))
        out.append(logit_pvalue(F.col(f"{a}_t"), F.col(f"{a}_k"), F.col(f"{a}_one"), fisher).alias(f"{a}_comb_pval"))
        weighted = F.when(F.col(f"{a}_w") != 0, F.col(f"{a}_wes") / F.col(f"{a}_w"))
        out.append((F.col(f"{a}_mean") if uniform else F.coalesce(weighted, F.col(f"{a}_mean"))).alias(f"{a}_comb_es"))
    return scored.groupBy(*by).agg(*aggs).select(*by, *out)


def replace_zero(df: DataFrame, columns: list[str], if_all_zero: float | None = None) -> DataFrame:
    """Zero p-values become the column's smallest positive one, a one-row table that is broadcast."""
    least = df.agg(*[F.min(F.when(F.col(c) > 0, F.col(c))).alias(f"__{c}") for c in columns])
    out = df.join(F.broadcast(least))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c) == 0, F.coalesce(f"__{c}", F.lit(if_all_zero))).otherwise(F.col(c)))
    return out.drop(*[f"__{c}" for c in columns])


def fdr(df: DataFrame, column: str, out: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, null where p is null; ties share a value.

    The p-values are counted first, so the ranking runs over distinct values. These are
    cut at ``parts`` quantiles: a range's first rank is the count of the ranges below it,
    and the least ratio of the ranges above it is carried down. Both come from one row a
    range, so no task holds all values; ``parts`` follows the shuffle partitions.
    """
    by = by or []
    df = settle(df, "fdr")  # ranks meet their rows by the p-value itself, so it must not be computed twice
    p = F.col(column)
    distinct = settle(df.where(p.isNotNull()).groupBy(*by, p.alias("__p")).agg(F.count("*").alias("__n")), "fdr")
    parts = parts or min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = distinct.agg(F.percentile_approx("__p", [i / parts for i in range(1, parts)] or [1.0], 10 * parts + 100)).first()[0]  # ``parts`` numbers
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>")
    distinct = distinct.withColumn("__range", F.size(F.filter(cuts, lambda c: c < F.col("__p"))))
    ranges = distinct.groupBy(*by, "__range").agg(F.sum("__n").alias("__size"))
    inside = Window.partitionBy(*by)
    below = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "__range", F.coalesce(F.sum("__size").over(below), F.lit(0)).alias("__base"), F.sum("__size").over(inside).alias("__m"))
    in_range = Window.partitionBy(*by, "__range").orderBy("__p")
    key = [*by, "__range"]
    ranked = distinct.join(ranges, key).withColumn("__rank", F.col("__base") + F.sum("__n").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("__ratio", F.col("__p") * F.col("__m") / F.col("__rank"))
    up = ranked.groupBy(*key).agg(F.min("__ratio").alias("__least"))
    # least values of all that follow, as running ones from the end: frames that end unbounded are gone through anew for each row
    above = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    up = up.select(*key, F.min("__least").over(above).alias("__above"))
    own = F.min("__ratio").over(Window.partitionBy(*by, "__range").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = ranked.join(up, key).withColumn(out, F.least(own, F.coalesce("__above", F.lit(float("inf"))), F.lit(1.0)))
    adjusted = adjusted.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__p", out)
    cond = p == F.col("__p")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return df.join(adjusted, cond, "left").drop("__p", *[f"__by_{c}" for c in by])


def preferred(df: DataFrame, fields: list[str], pval: str = "pval") -> DataFrame:
    """The allele with the smaller p (ties: alt), and its values of ``fields``."""
    ref = F.col(f"ref_{pval}") < F.col(f"alt_{pval}")
    out = df.withColumn("pref_allele", F.when(ref, "ref").otherwise("alt"))
    return out.withColumns({f: F.when(ref, F.col(f"ref_{f}")).otherwise(F.col(f"alt_{f}")) for f in fields})


def significance(df: DataFrame, alpha: float = 0.05, ref: str = "ref_fdr", alt: str = "alt_fdr") -> DataFrame:
    """SNVs below ``alpha`` by ref, alt, both and either, all of them, and the percentage (null without any)."""
    r, a = F.col(ref) < alpha, F.col(alt) < alpha
    return df.agg(F.count_if(r).alias("ref"), F.count_if(a).alias("alt"), F.count_if(r & a).alias("both"), F.count_if(r | a).alias("either"), F.count("*").alias("tested")).withColumn(
        "percent", F.round(F.try_divide(100 * F.col("either"), F.col("tested")), 4)
    )


def roll_up(scored: DataFrame, order: list[str]) -> DataFrame:
    """Per SNV: mean BAD, largest coverage, replicates, and lists of the replicates' values in order, scores included where there are any."""
    values = ["bad", "scorefile", "ref_count", "alt_count", *[c for c in ("ref_es", "alt_es", "ref_pval", "alt_pval") if c in scored.columns]]
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in values if c not in order])))
    rows = scored.groupBy(*SNV).agg(F.avg("bad").alias("mean_bad"), F.max(F.col("ref_count") + F.col("alt_count")).alias("max_cover"), F.count("*").alias("n_reps"), listed.alias("l"))
    lists = [F.concat_ws(",", F.col(f"l.{c}").cast("array<string>")).alias(f"{c}s") for c in values]
    return rows.select(*SNV, "mean_bad", "max_cover", "n_reps", *lists)


def union_projects(projects: list[DataFrame]) -> DataFrame:
    """Projects as extra replicates, tagged with their number and ``[number] file``."""
    out = None
    for i, df in enumerate(projects):
        part = df.withColumn("project", F.lit(i)).withColumn("scorefile", F.concat(F.lit(f"[{i}] "), "scorefile"))
        out = part if out is None else out.unionByName(part)
    return out
