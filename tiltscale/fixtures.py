"""The canonical tables, derived from the driver's tables.

``RECORDS`` is valid in Spark SQL and in DuckDB; the SQL oracles use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = """
SELECT concat('chr', cast(l_partkey % 22 + 1 as varchar(4))) AS chrom, l_partkey AS start,
  case when l_partkey % 10 = 9 then '.' else concat('rs', cast(l_partkey as varchar(20))) end AS id,
  substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) AS ref,
  case when l_partkey % 50 = 49 then 'TA' else substr('CGTA', cast(l_partkey % 4 as int) + 1, 1) end AS alt,
  cast(l_linenumber * 5 as double) AS qual, l_returnflag <> 'R' AS db,
  case when l_linenumber = 7 then '0/0' when l_linenumber = 6 then '1/0' else '0/1' end AS gt,
  cast(l_quantity as int) AS ad0, cast((l_orderkey * 7 + l_partkey * 3 + l_linenumber * 13) % 50 + 1 as int) AS ad1,
  case cast(l_partkey % 5 as int) when 0 then 1.0e0 when 1 then 1.33333e0 when 2 then 1.5e0 when 3 then 2.0e0 else 3.0e0 end AS bad,
  concat('sample_', cast(l_suppkey % 12 as varchar(4)), '.tsv') AS scorefile,
  cast(l_suppkey % 12 as int) AS sample, l_orderkey AS orderkey, l_orderkey * 10 + l_linenumber AS row_order
FROM lineitem
"""

#: BAD intervals: bins of ten positions, and one in seven overlapped by a later row.
BAD_MAP = """
SELECT concat('chr', cast(p_partkey % 22 + 1 as varchar(4))) AS chrom, p_partkey AS start, p_partkey + 10 AS "end",
  cast(1 + cast((p_partkey - p_partkey % 10) / 10 as int) % 5 as double) AS bad, p_partkey AS map_order FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT concat('chr', cast(p_partkey % 22 + 1 as varchar(4))), p_partkey - 2, p_partkey + 3, 6.0e0, 100000000 + p_partkey FROM part WHERE p_partkey % 7 = 0
"""

#: BAD by position, for even positions.
BAD_POINTS = """
SELECT concat('chr', cast(p_partkey % 22 + 1 as varchar(4))) AS chrom, p_partkey AS pos, cast(1 + p_partkey % 4 as double) AS bad, p_partkey AS map_order FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT concat('chr', cast(p_partkey % 22 + 1 as varchar(4))), p_partkey, 5.0e0, 100000000 + p_partkey FROM part WHERE p_partkey % 6 = 0
"""

#: Decoded reads: two reads of a name, one base string each.
READS = """
SELECT cast(l_orderkey as varchar(20)) AS read_name, l_linenumber % 2 = 1 AS is_read1, concat('chr', cast(l_partkey % 22 + 1 as varchar(4))) AS contig,
  l_partkey - l_suppkey % 20 AS pos, substr('ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT', cast(l_quantity as int) % 4 + 1, 36) AS seq, l_returnflag <> 'R' AS remapped
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace('"end"', "`end`").replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def records(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Records of one sample each, with the genotype and depths as text and numbers; ``placed``: and ``place``, their file and row in it."""
    if not placed:
        return _sql(spark, sf_dir, RECORDS, "lineitem")
    source = table(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return spark.sql(RECORDS.replace("FROM lineitem", ", place FROM {source}"), source=source)


def canonical(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Records with alternative alleles and samples as arrays; ``placed``: and ``place``, as in ``records``."""
    gt = F.transform(F.split("gt", "/"), lambda x: x.cast("int"))
    samples = F.array(F.struct(gt.alias("gt"), F.array("ad0", "ad1").alias("ad")))
    return records(spark, sf_dir, placed).select(
        "chrom", "start", "id", "ref", F.array_remove(F.split("alt", "(?!^)"), "").alias("alts"), "qual", "db", "bad", samples.alias("samples"), "scorefile", "row_order", "sample", "orderkey", *["place"] * placed
    )


def bad_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, BAD_MAP, "part")


def bad_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, BAD_POINTS, "part")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, READS, "lineitem")
