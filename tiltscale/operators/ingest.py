"""From records to observations and count tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNV = ["chrom", "start", "alt"]


def quality(df: DataFrame, min_qual: float = 10) -> DataFrame:
    """Quality at least ``min_qual`` and a reference of one base."""
    return df.where((F.col("qual") >= min_qual) & (F.length("ref") == 1))


def database(df: DataFrame) -> DataFrame:
    """Records flagged in the database, and those without the flag."""
    return df.where(F.coalesce("db", F.lit(True)))


def _anchored(pattern: str) -> str:
    return f"^(?:{pattern})"


def matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Values that match from their start."""
    return df.where(F.col(column).rlike(_anchored(pattern)))


def rs_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("id").startswith("rs"), F.lit(False)))


def biallelic(df: DataFrame) -> DataFrame:
    """Exactly one alternative allele, of one base."""
    return df.where((F.size("alts") == 1) & (F.length(F.get("alts", F.lit(0))) == 1))


def heterozygous(df: DataFrame, gt: str = "gt") -> DataFrame:
    a, b = F.get(gt, F.lit(0)), F.get(gt, F.lit(1))
    return df.where(a.isNotNull() & b.isNotNull() & (a != b))


def allele_depth(df: DataFrame, gt: str = "gt", ad: str = "ad") -> DataFrame:
    """ref_count and alt_count by the genotype's order of alleles."""
    a, b, x, y = F.get(gt, F.lit(0)), F.get(gt, F.lit(1)), F.get(ad, F.lit(0)), F.get(ad, F.lit(1))
    return df.withColumn("ref_count", ((1 - a) * x + (1 - b) * y).cast("int")).withColumn("alt_count", (a * x + b * y).cast("int"))


def depth(df: DataFrame, min_cnt: int = 5, max_cover: int = 1000) -> DataFrame:
    return df.where((F.col("ref_count") >= min_cnt) & (F.col("alt_count") >= min_cnt) & (F.col("ref_count") + F.col("alt_count") < max_cover))


def bad_key(bad: Column) -> Column:
    """An integer key of a BAD rounded to five digits."""
    return F.round(bad * 100_000).cast("long")


def round_bad(df: DataFrame, drop: Iterable[float] = ()) -> DataFrame:
    """BAD rounded to five digits, without the listed BADs."""
    keys = [round(b * 100_000) for b in drop]
    out = df.withColumn("bad", F.round("bad", 5))
    return out.where(~bad_key(F.col("bad")).isin(keys)) if keys else out


def fit_filter(counts: DataFrame, max_count: int, max_cover: int, left: int) -> DataFrame:
    ref, alt = F.col("ref_count"), F.col("alt_count")
    return counts.where((ref < max_count) & (alt < max_count) & (ref > left) & (alt > left) & (ref + alt < max_cover))


def orient(df: DataFrame) -> DataFrame:
    """One row per allele: x counts the scored allele, ``slice`` the fixed one."""
    sides = F.array(*[F.struct(F.lit(a).alias("allele"), F.col(f"{a}_count").alias("x"), F.col(f"{b}_count").alias("slice")) for a, b in (("ref", "alt"), ("alt", "ref"))])
    return df.select("*", F.inline(sides))


def range_join_bad(df: DataFrame, bad_map: DataFrame, finest: int = 6) -> DataFrame:
    """BAD of the interval [start, end) that holds the position; the last map row wins.

    An interval goes to bins of the power of two that is as long as it or longer, so it
    meets two bins at most, however long it is; a position looks into one bin of each
    length that the map has, a few tens at most. The result has ``map_bad``, null on a
    miss, one row per row of ``df``. Positions are resolved once each, however many records
    stand there.
    """
    sized = bad_map.where("`end` > start").withColumn("level", F.greatest(F.ceil(F.log2(F.col("end") - F.col("start"))), F.lit(finest)).cast("int"))
    levels = sorted(r.level for r in sized.select("level").distinct().collect())  # at most 64
    places = df.select("chrom", "start").distinct()
    at = lambda c: F.expr(f"shiftright({c}, level)")
    binned = sized.select(
        "chrom", F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), F.col("bad").alias("map_bad"), "map_order", "level",
    ).withColumn("bin", F.explode(F.sequence(at("lo"), at("hi - 1"))))
    looked = places.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("bin", at("cast(start as bigint)"))
    met = looked.join(binned, ["chrom", "level", "bin"]).where("start >= lo and start < hi")
    found = met.groupBy("chrom", "start").agg(F.max_by("map_bad", "map_order").alias("map_bad"))
    return df.join(found, ["chrom", "start"], "left")


def point_join_bad(df: DataFrame, points: DataFrame) -> DataFrame:
    """BAD at the exact position; the last map row wins."""
    last = last_point(points).withColumnRenamed("pos", "start").withColumnRenamed("bad", "map_bad")
    return df.join(last, ["chrom", "start"], "left")


def last_point(points: DataFrame) -> DataFrame:
    return points.groupBy("chrom", "pos").agg(F.max_by("bad", "map_order").alias("bad"))


def resolve_bad(df: DataFrame, default: float | None) -> DataFrame:
    """The map's BAD, else the record's own, else the default; rows with none are dropped.

    With a map and no default a miss drops the row, as the record's own BAD only counts
    together with a default.
    """
    own = F.when(F.col("bad") != 0, F.col("bad"))
    picked = F.coalesce("map_bad", own, F.lit(default)) if default is not None else F.col("map_bad")
    return df.withColumn("bad", picked).drop("map_bad").where(F.col("bad").isNotNull())


def observations(records: DataFrame, min_qual: float = 10, min_cnt: int = 5, max_cover: int = 1000, drop_bads: Iterable[float] = ()) -> DataFrame:
    """All default filters: one row per heterozygous sample of a biallelic variant.

    Everything up to here is narrow: no shuffle between the scan and the observations.
    """
    kept = round_bad(biallelic(quality(records, min_qual)), drop_bads)
    flat = kept.withColumn("s", F.explode("samples")).select("*", F.col("s.gt").alias("gt"), F.col("s.ad").alias("ad")).drop("s", "samples")
    counted = depth(allele_depth(heterozygous(flat)), min_cnt, max_cover)
    return counted.withColumn("alt", F.get("alts", F.lit(0))).drop("alts", "gt", "ad", "db", "qual")


def count_table(obs: DataFrame) -> DataFrame:
    return obs.groupBy("bad", "ref_count", "alt_count").agg(F.count("*").alias("n"))


def symmetrify(counts: DataFrame) -> DataFrame:
    """n'(a, b) = (n(a, b) + n(b, a)) // 2; the diagonal enters twice and stays."""
    swapped = counts.select("bad", F.col("alt_count").alias("ref_count"), F.col("ref_count").alias("alt_count"), "n")
    both = counts.select("bad", "ref_count", "alt_count", "n").unionByName(swapped)
    return both.groupBy("bad", "ref_count", "alt_count").agg(F.sum("n").alias("t")).selectExpr("bad", "ref_count", "alt_count", "t div 2 AS n")


def summary(obs: DataFrame) -> DataFrame:
    """Distinct SNVs and observations per BAD, and totals; an SNV of two BADs counts twice in the total."""
    by_bad = obs.groupBy("bad").agg(F.count_distinct(*SNV).alias("snvs"), F.count("*").alias("observations"))
    total = by_bad.agg(F.lit(None).cast("double").alias("bad"), F.sum("snvs").alias("snvs"), F.sum("observations").alias("observations"))
    return by_bad.unionByName(total)


def inconsistent_bads(obs: DataFrame) -> DataFrame:
    """SNVs seen with more than one BAD."""
    return obs.groupBy(*SNV).agg(F.count_distinct("bad").alias("bads")).where("bads > 1")


def require_consistent(obs: DataFrame) -> DataFrame:
    """``obs``, or an error if an SNV has several BADs; one row reaches the driver."""
    odd = inconsistent_bads(obs).first()
    if odd is not None:
        raise ValueError(f"several BADs at {odd.chrom}:{odd.start} {odd.alt}")
    return obs


def zero_bad(obs: DataFrame) -> DataFrame:
    return obs.where("bad = 0")


def left_bound(counts: DataFrame) -> DataFrame:
    return counts.agg((F.min(F.least("ref_count", "alt_count")) - 1).alias("left_bound"))


def first_metadata(obs: DataFrame, order: list[str]) -> DataFrame:
    """id and ref of each SNV's first observation in the given order."""
    return obs.groupBy(*SNV).agg(F.min_by(F.struct("id", "ref"), F.struct(*order)).alias("m")).select(*SNV, "m.id", "m.ref")


def file_ids(obs: DataFrame) -> DataFrame:
    """Number of each scorefile in path order, from 0; the window runs over distinct files only."""
    return obs.select("scorefile").distinct().withColumn("file_id", F.row_number().over(Window.orderBy("scorefile")) - 1)


def missing_snvs(snvs: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``wanted`` that no SNV meets."""
    return wanted.join(snvs, on, "left_anti")


def select_snvs(snvs: DataFrame, wanted: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """SNVs that ``wanted`` names by id and alt, or by place and alt; ``strict``: one that is missing is an error."""
    if strict and (lost := missing_snvs(snvs, wanted, on).limit(5).collect()):
        raise ValueError(f"no such SNVs: {[tuple(r) for r in lost]}")
    return snvs.join(wanted.select(*on), on, "left_semi")
