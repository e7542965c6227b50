"""Filters, BAD maps, count tables and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import ingest as op
from .common import OBS, REC, Registry, counted, observed

R = Registry()
_KEY = ["row_order"]


def _records(step):
    return lambda s, d: step(fx.canonical(s, d)).select("chrom", "start", "id", "scorefile", "row_order")


def _where(sql: str) -> str:
    return REC + f"SELECT chrom, start, id, scorefile, row_order FROM records WHERE {sql}"


R.add("b1_quality", _records(op.quality), _where("qual >= 10 AND length(ref) = 1"))
R.add("b2_database", _records(op.database), _where("coalesce(db, true)"))
R.add("b3_chromosome_regex", _records(lambda r: op.matches(r, "chrom", "chr1|chr2$")), _where("regexp_matches(chrom, '^(chr1|chr2$)')"))
R.add("b4_rs_ids", _records(op.rs_only), _where("starts_with(id, 'rs')"))
R.add("b5_id_regex", _records(lambda r: op.matches(r, "id", "rs[0-9]*7")), _where("regexp_matches(id, '^rs[0-9]*7')"))
R.add("b6_biallelic", _records(op.biallelic), _where("length(alt) = 1"))


def _flat(s, d):
    return fx.canonical(s, d).withColumn("s", F.explode("samples")).select("*", "s.gt", "s.ad")


R.add("b7_heterozygous", lambda s, d: op.heterozygous(_flat(s, d)).select("chrom", "start", "id", "scorefile", "row_order"), _where("split_part(gt, '/', 1) <> split_part(gt, '/', 2)"))
R.add(
    "b8_allele_depth",
    lambda s, d: op.allele_depth(op.heterozygous(_flat(s, d))).select("row_order", "ref_count", "alt_count"),
    REC + "SELECT row_order, CASE WHEN gt = '1/0' THEN ad1 ELSE ad0 END AS ref_count, CASE WHEN gt = '1/0' THEN ad0 ELSE ad1 END AS alt_count FROM records WHERE gt <> '0/0'",
)
R.add(
    "b9_depth",
    lambda s, d: op.depth(op.allele_depth(op.heterozygous(_flat(s, d))), 8, 60).select("row_order", "ref_count", "alt_count"),
    REC + "SELECT row_order, CASE WHEN gt = '1/0' THEN ad1 ELSE ad0 END AS ref_count, CASE WHEN gt = '1/0' THEN ad0 ELSE ad1 END AS alt_count FROM records WHERE gt <> '0/0' AND ad0 >= 8 AND ad1 >= 8 AND ad0 + ad1 < 60",
)
_MAPPED = f""", bad_map AS ({fx.BAD_MAP}), hit AS (
  SELECT r.chrom, r.start, arg_max(m.bad, m.map_order) AS map_bad FROM (SELECT DISTINCT chrom, start FROM records) r JOIN bad_map m ON r.chrom = m.chrom AND r.start >= m.start AND r.start < m."end" GROUP BY ALL)
"""
R.add(
    "c1_bad_range_join",
    lambda s, d: op.range_join_bad(fx.records(s, d), fx.bad_map(s, d)).select("row_order", "map_bad"),
    REC.rstrip() + _MAPPED + "SELECT r.row_order, h.map_bad FROM records r LEFT JOIN hit h USING (chrom, start)",
)
R.add(
    "c2_bad_point_join",
    lambda s, d: op.point_join_bad(fx.records(s, d), fx.bad_points(s, d)).select("row_order", "map_bad"),
    REC.rstrip() + f", p AS (SELECT chrom, pos, arg_max(bad, map_order) AS map_bad FROM ({fx.BAD_POINTS}) GROUP BY chrom, pos) SELECT row_order, map_bad FROM records LEFT JOIN p ON records.chrom = p.chrom AND start = pos",
)
R.add(
    "b10_resolve_bad",
    lambda s, d: op.resolve_bad(op.range_join_bad(fx.records(s, d).withColumn("bad", F.when(F.col("start") % 3 == 0, 0.0).otherwise(F.col("bad"))), fx.bad_map(s, d)), 1.0).select("row_order", "bad"),
    REC.rstrip() + _MAPPED + "SELECT r.row_order, coalesce(h.map_bad, nullif(CASE WHEN start % 3 = 0 THEN 0 ELSE bad END, 0), 1.0) AS bad FROM records r LEFT JOIN hit h USING (chrom, start)",
)
R.add(
    "b11_round_and_drop_bads",
    lambda s, d: op.round_bad(fx.records(s, d).withColumn("bad", F.col("bad") + 0.000001), [1.5, 3.0]).select("row_order", "bad"),
    REC + "SELECT row_order, round(bad + 0.000001, 5) AS bad FROM records WHERE round(bad + 0.000001, 5) NOT IN (1.5, 3.0)",
)
R.add("d1_count_table", lambda s, d: counted(s, d), OBS + "SELECT * FROM counts")
R.add(
    "d2_symmetrify",
    lambda s, d: op.symmetrify(counted(s, d)),
    OBS + "SELECT bad, ref_count, alt_count, CAST(sum(n) // 2 AS BIGINT) AS n FROM (SELECT * FROM counts UNION ALL SELECT bad, alt_count, ref_count, n FROM counts) GROUP BY ALL",
)
_SUMMARY = "SELECT bad, count(DISTINCT (chrom, start, alt)) AS snvs, count(*) AS observations FROM obs GROUP BY bad"
R.add("d3_summary", lambda s, d: op.summary(observed(s, d)), OBS + f"SELECT * FROM ({_SUMMARY}) UNION ALL SELECT NULL, CAST(sum(snvs) AS BIGINT), CAST(sum(observations) AS BIGINT) FROM ({_SUMMARY})")
R.add(
    "d4_inconsistent_bads",
    lambda s, d: op.inconsistent_bads(observed(s, d).withColumn("bad", F.when((F.col("start") % 50 == 0) & (F.col("row_order") % 10 == 5), 6.0).otherwise(F.col("bad")))),
    OBS + "SELECT chrom, start, alt, count(DISTINCT CASE WHEN start % 50 = 0 AND row_order % 10 = 5 THEN 6.0 ELSE bad END) AS bads FROM obs GROUP BY ALL HAVING bads > 1",
)
R.add(
    "b12_fit_filter",
    lambda s, d: op.fit_filter(counted(s, d), 45, 80, 6),
    OBS + "SELECT * FROM counts WHERE ref_count < 45 AND alt_count < 45 AND ref_count > 6 AND alt_count > 6 AND ref_count + alt_count < 80",
)
R.add(
    "b13_orient",
    lambda s, d: op.orient(counted(s, d)).select("bad", "allele", "x", "slice", "n"),
    OBS + "SELECT bad, 'ref' AS allele, ref_count AS x, alt_count AS slice, n FROM counts UNION ALL SELECT bad, 'alt', alt_count, ref_count, n FROM counts",
)
R.add("b18_zero_bad", lambda s, d: op.zero_bad(fx.records(s, d).withColumn("bad", F.when(F.col("start") % 11 == 0, 0.0).otherwise(F.col("bad")))).select("row_order", "bad"), REC + "SELECT row_order, 0.0::DOUBLE AS bad FROM records WHERE start % 11 = 0")
R.add("e9_left_bound", lambda s, d: op.left_bound(counted(s, d)), OBS + "SELECT min(least(ref_count, alt_count)) - 1 AS left_bound FROM counts")
R.add(
    "e8_first_metadata",
    lambda s, d: op.first_metadata(observed(s, d), ["sample", "row_order"]),
    OBS + "SELECT chrom, start, alt, arg_min(id, (sample, row_order)) AS id, arg_min(ref, (sample, row_order)) AS ref FROM obs GROUP BY chrom, start, alt",
)
R.add("a5_scorefile_ids", lambda s, d: op.file_ids(observed(s, d)), OBS + "SELECT scorefile, row_number() OVER (ORDER BY scorefile) - 1 AS file_id FROM (SELECT DISTINCT scorefile FROM obs)")
R.add("e7_sorted_counts", lambda s, d: counted(s, d).orderBy("bad", "ref_count", "alt_count"), OBS + "SELECT * FROM counts ORDER BY bad, ref_count, alt_count")
