"""Result tables as users read them, and short names of scorefiles."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import chosen_set
from . import combine, ingest

#: Endings that a scorefile's name loses.
SUFFIXES = ("gz", "vcf", "bam", "tsv", "csv", "zip", "lzma", "bz2", "bed")
PREFERRED = ["comb_es", "comb_pval", "fdr_comb_pval"]


def strip_suffixes(name: Column) -> Column:
    """The name without known endings; a name that is nothing else stays as it is."""
    short = F.regexp_replace(name, r"(\.(" + "|".join(SUFFIXES) + r"))+$", "")
    return F.when(short == "", name).otherwise(short)


def short_names(df: DataFrame, column: str = "scorefile") -> DataFrame:
    """``column`` without the folders that all names share and without known endings.

    The names' smallest and largest have the common folders of all; these two reach the driver.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    folders = os.path.commonprefix([low or "", high or ""]).rpartition("/")[0]
    cut = len(folders) + 1 if folders else 0
    return df.withColumn(column, strip_suffixes(F.substr(F.col(column), F.lit(cut + 1))))


def raw_pvalues(obs: DataFrame, scores: DataFrame) -> DataFrame:
    """Every observation with its scores and the preferred allele's, by scorefile."""
    rows = combine.preferred(combine.with_scores(obs, scores), ["es", "pval"])
    kept = ["bad", "id", "ref", "alt", "ref_count", "alt_count", "ref_es", "alt_es", "ref_pval", "alt_pval", "es", "pval"]
    return short_names(rows.select("scorefile", F.col("chrom").alias("#chr"), "start", (F.col("start") + 1).alias("end"), *kept))


def combined_pvalues(combined: DataFrame, scored: DataFrame, order: list[str], replicates: bool = False) -> DataFrame:
    """Combined results of SNVs with what their replicates were, and if asked the replicates' values as lists."""
    parts = combine.roll_up(scored, order)
    lists = [c for c in parts.columns if c.endswith("s") and c != "n_reps"]
    rows = combined.join(parts, combine.SNV).join(ingest.first_metadata(scored, order), combine.SNV)
    rows = combine.preferred(rows, PREFERRED, "comb_pval")
    sides = [f"{a}_{c}" for c in PREFERRED for a in ("ref", "alt")]
    return rows.select("chrom", "start", (F.col("start") + 1).alias("end"), "mean_bad", "id", "max_cover", "ref", "alt", "n_reps", *(lists if replicates else []), *sides, "pref_allele", *PREFERRED)


def multi_project(projects: DataFrame, scores: DataFrame, thresholds: DataFrame, order: list[str], uniform: bool = True) -> DataFrame:
    """Projects combined as replicates: a replicate below its project's threshold goes, a missing score counts as p = 1."""
    scored = combine.gate_each(combine.with_scores(projects, scores, "left"), thresholds, ["project"])
    both = combine.replace_zero(combine.combine(scored, uniform), ["ref_comb_pval", "alt_comb_pval"], 1.0)
    for a in ("ref", "alt"):
        both = combine.fdr(both, f"{a}_comb_pval", f"{a}_fdr_comb_pval")
    return combined_pvalues(both, scored, order, replicates=True)


def stored_members(spark: SparkSession, paths: list[str], subname: str | None = None) -> DataFrame:
    """The scorefiles, tagged with their project's number, that each project's combine of ``subname`` was made of.

    ``paths``: one stage table of members (scorefile) for each project. Without ``subname`` a
    project's default set is taken, or its only one.
    """
    sets = [chosen_set(spark, path, subname).select(F.concat(F.lit(f"[{i}] "), "scorefile").alias("scorefile")) for i, path in enumerate(paths)]
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.distinct()
