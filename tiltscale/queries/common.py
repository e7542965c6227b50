"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures
from ..operators import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: The default observations in SQL, as the tables ``records`` and ``obs``.
OBS = f"""WITH records AS ({fixtures.RECORDS}), obs AS (
  SELECT chrom, start, alt, id, ref, scorefile, sample, orderkey, row_order, bad,
    CASE WHEN gt = '1/0' THEN ad1 ELSE ad0 END AS ref_count, CASE WHEN gt = '1/0' THEN ad0 ELSE ad1 END AS alt_count
  FROM records WHERE qual >= 10 AND length(ref) = 1 AND length(alt) = 1 AND gt IN ('0/1', '1/0') AND ad0 >= 5 AND ad1 >= 5 AND ad0 + ad1 < 1000
), counts AS (SELECT bad, ref_count, alt_count, count(*) AS n FROM obs GROUP BY ALL)
"""
REC = f"WITH records AS ({fixtures.RECORDS})\n"


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql


def observed(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    return ingest.observations(fixtures.canonical(spark, sf_dir, placed))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.count_table(observed(spark, sf_dir))
